"""Model lists of providers, hosts of nodes, and the eligibility of keys."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.functions.templates import WHITE

#: API formats of model lists.
ANTHROPIC, GOOGLE = "anthropic_messages", "google_generative_ai"


def model_ids(body: Column, api_format: Column) -> Column:
    """Trimmed ids of a model list, each at its first place; null if the body isn't such JSON."""
    google = api_format == GOOGLE
    named = F.from_json(body, "struct<models: array<struct<name: string>>>", {"mode": "PERMISSIVE"})
    listed = F.from_json(body, "struct<data: array<struct<id: string>>>", {"mode": "PERMISSIVE"})
    names = F.transform(F.coalesce(named["models"]["name"], F.array().cast("array<string>")), lambda n: F.regexp_replace(n, "^models/", ""))
    ids = F.coalesce(listed["data"]["id"], F.array().cast("array<string>"))
    found = F.when(google, names).otherwise(ids)
    trimmed = F.transform(found, lambda i: F.trim(F.coalesce(i, F.lit("")), F.lit(WHITE)))
    return F.when(F.json_object_keys(body).isNotNull(), F.array_distinct(F.filter(trimmed, lambda i: i != "")))


def private_host(url: Column) -> Column:
    """Whether a node's URL names this machine or a private or link-local address; false for what is no URL."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))
    v4 = r"(?:127|10)(?:\.\d{1,3}){3}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2}|169\.254(?:\.\d{1,3}){2}"
    v6 = r"\[(?:::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]"
    return (host == "") | (host == "localhost") | F.endswith(host, F.lit(".localhost")) | host.rlike(rf"^(?:{v4}|{v6})$")


@F.pandas_udf(T.StringType())
def ip_verdict(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """'ok', 'denied', or 'unknown' if a rule is neither an address nor a network, of (ip, allowed, denied) rules."""

    def within(ip, rules) -> bool:
        """Raises ValueError at a rule that can't be read, unless one before it matches."""
        for rule in rules:
            try:
                if ip == ipaddress.ip_address(rule):
                    return True
            except ValueError:
                network = ipaddress.ip_network(rule, strict=False)
                if ip is not None and ip in network:
                    return True
        return False

    def verdict(ip, white, black) -> str:
        try:
            ip = ipaddress.ip_address(ip) if ip else None
        except ValueError:
            ip = None
        white, black = [] if white is None else list(white), [] if black is None else list(black)
        try:
            denied, accepted = within(ip, black), within(ip, white)
        except (ValueError, TypeError):
            return "unknown"
        return "denied" if denied or (white and not accepted) else "ok"

    for ips, whites, blacks in batches:
        yield pd.Series([verdict(*row) for row in zip(ips, whites, blacks)], dtype="object")


def eligibility(key_status: Column, user_status: Column, expired: Column, group_status: Column, allowed: Column, verdict: Column, platform: Column) -> Column:
    """passed, rejected or unknown, by the first test that decides; a null key status means that no key was found."""
    return (
        F.when(key_status.isNull(), "rejected")
        .when((key_status != "active") | ~user_status.eqNullSafe(F.lit("active")), "rejected")
        .when(expired, "rejected")
        .when(~group_status.eqNullSafe(F.lit("active")) | ~F.coalesce(allowed, F.lit(False)), "rejected")
        .when(verdict == "unknown", "unknown")
        .when(verdict == "denied", "rejected")
        .when(platform == "composite", "unknown")
        .otherwise("passed")
    )
