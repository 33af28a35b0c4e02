"""Moderation and quota analytics of LLM requests on Spark."""
