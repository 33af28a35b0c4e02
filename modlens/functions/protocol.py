"""Column functions of request paths, clients and node replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def protocol(path: Column) -> Column:
    """The protocol family of a request path; of several that fit, the first counts."""
    has, ends = path.contains, path.endswith
    media = has("/images/") | has("/videos") | has("/audio/") | path.isin("/tts", "/stt") | has("/custom-voices") | ends("/web_search") | ends("/x_search")
    return (
        F.when(has("/responses"), "responses")
        .when(ends("/chat/completions"), "chat_completions")
        .when(has("/messages"), "anthropic_messages")
        .when(has("/models/") & (has(":generateContent") | has(":streamGenerateContent")), "gemini")
        .when(ends("/embeddings"), "openai_embeddings")
        .when(ends("/alpha/search"), "openai_alpha_search")
        .when(media, "media")
        .otherwise("unsupported")
    )


def client(agent: Column, originator: Column | None = None) -> Column:
    """The client that sent a request, by its headers; generic if none is known."""
    a = F.coalesce(agent, F.lit(""))
    codex = a.contains("codex_cli_rs") | a.startswith("codex_")
    if originator is not None:
        codex = codex | originator.eqNullSafe(F.lit("codex_cli_rs"))
    return F.when(a.startswith("claude-cli/"), "claude_code").when(codex, "codex").when(a.startswith("GeminiCLI/"), "gemini_cli").otherwise("generic")


def reply_error(finish: Column, refusal: Column, text: Column) -> Column:
    """The error code of a scoring node's reply: refused, cut off, or without text."""
    return F.when(refusal.isNotNull() & (refusal != ""), "model_refusal").when(finish.isin("length", "max_tokens", "MAX_TOKENS", "incomplete"), "incomplete_response").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_response")


def response_id(body: Column) -> Column:
    """The id of a JSON reply, or of the first response.created event of an event stream."""
    plain = F.get_json_object(body, "$.id")
    event = F.regexp_extract(body, r'(?m)^data:\s*(\{.*"type"\s*:\s*"response\.created".*\})\s*$', 1)
    return F.coalesce(plain, F.get_json_object(event, "$.response.id"))


def stream_events(body: Column) -> Column:
    """The JSON texts of an event stream's data lines, in order, without empty ones and the end mark."""
    bare = lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))
    lines = F.transform(F.filter(F.transform(F.split(body, "\n"), bare), lambda x: x.startswith("data:")), lambda x: bare(F.substring(x, 6, 1 << 30)))
    return F.filter(lines, lambda x: ~x.isin("", "[DONE]"))


def folded_stream(body: Column) -> Column:
    """An event stream of a Responses reply, folded in order: struct<text, refusal, final, error>.

    final is the last event's `response` object. Its own output text counts if it has any that isn't blank; else the deltas in their order, or the
    text of a done event that came before any delta. error: invalid_event if an event is no JSON object or its response none, no_final without a
    response; then the other fields are null.
    """

    def at(e: Column, key: str, kind: str = "string") -> Column:
        return F.try_variant_get(e, f"$.{key}", kind)

    def is_object(e: Column) -> Column:
        return F.try_variant_get(e, "$", "map<string,variant>").isNotNull()

    def step(s: Column, raw: Column) -> Column:
        e = F.try_parse_json(raw)
        kind, response = at(e, "type"), at(e, "response", "variant")
        delta = F.coalesce(at(e, "delta"), F.lit(""))
        added = F.when(kind == "response.output_text.delta", delta).when((kind == "response.output_text.done") & (s["text"] == ""), F.coalesce(at(e, "text"), F.lit(""))).otherwise("")
        odd = ~is_object(e) | (response.isNotNull() & ~F.is_variant_null(response) & ~is_object(response))
        return F.struct(
            F.concat(s["text"], added).alias("text"), F.concat(s["refusal"], F.when(kind == "response.refusal.delta", delta).otherwise("")).alias("refusal"),
            F.when(is_object(response), F.to_json(response)).otherwise(s["final"]).alias("final"), (s["odd"] | F.coalesce(odd, F.lit(True))).alias("odd"),
        )

    def parts(final: Column) -> Column:
        items = F.coalesce(F.try_variant_get(F.try_parse_json(final), "$.output", "array<variant>"), F.array().cast("array<variant>"))
        return F.flatten(F.transform(items, lambda i: F.coalesce(F.try_variant_get(i, "$.content", "array<variant>"), F.array().cast("array<variant>"))))

    def said(final: Column, key: str) -> Column:
        texts = F.filter(F.transform(parts(final), lambda p: at(p, key)), lambda x: F.trim(x) != "")
        return F.when(F.size(texts) > 0, F.array_join(texts, ""))

    def ended(s: Column) -> Column:
        error = F.when(s["odd"], "invalid_event").when(s["final"].isNull(), "no_final")
        text, refusal = said(s["final"], "text"), said(s["final"], "refusal")
        own = text.isNotNull() | refusal.isNotNull()
        deltas = F.when(s["refusal"] == "", F.when(s["text"] != "", s["text"]))
        fields = {"text": F.when(own, text).otherwise(deltas), "refusal": F.when(own, refusal).otherwise(F.when(s["refusal"] != "", s["refusal"])), "final": s["final"]}
        return F.struct(*[F.when(error.isNull(), c).alias(k) for k, c in fields.items()], error.alias("error"))

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("refusal"), F.lit(None).cast("string").alias("final"), F.lit(False).alias("odd"))
    return F.aggregate(stream_events(body), start, step, ended)


def chat_stream_text(body: Column) -> Column:
    """The text of a Chat Completions stream: its choices' deltas in order."""
    return F.array_join(F.transform(stream_events(body), lambda e: F.coalesce(F.get_json_object(e, "$.choices[0].delta.content"), F.lit(""))), "")
