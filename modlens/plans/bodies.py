"""Request bodies and reply streams of the protocol families, made from the conversations, and what the decoders make of them.

A conversation's turns become the messages of one body. Form and block types follow the place of a turn; some bodies are
broken on purpose (conv_id % 7 = 3: something after the object, 5: a repeated key) and give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions import protocol, requests
from modlens.sources.tables import Tables


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _say(pattern: str, *values: Column) -> Column:
    """pattern with each ~ replaced by the next value."""
    texts = pattern.split("~")
    parts = [F.lit(texts[0])]
    for v, t in zip(values, texts[1:], strict=True):
        parts += [v, F.lit(t)]
    return F.concat(*parts)


def _bodies(t: Tables, make) -> DataFrame:
    """conv_id, body; make(conv_id, turns) gives the JSON, turns an array of (turn, role, text) in order."""
    turns = t.turns.select("conv_id", "turn", "role", "text")
    by = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    body = make(F.col("conv_id").cast("string"), F.col("turns"))
    odd = F.pmod("conv_id", F.lit(7))
    return by.select("conv_id", F.when(odd == 3, F.concat(body, F.lit(" {}"))).when(odd == 5, F.regexp_replace(body, r"^\{", '{"n":1,"n":2,')).otherwise(body).alias("body"))


def _joined(turns: Column, make) -> Column:
    return F.array_join(F.transform(turns, make), ",")


def _rows(bodies: DataFrame, name: str) -> DataFrame:
    rows = requests.prompt_items(bodies, name, "body", "conv_id")
    return rows.withColumns({"texts": F.array_join("texts", "|"), "previous": F.coalesce("previous", F.lit(""))})


def message_items(t: Tables) -> DataFrame:
    """Chat bodies: texts, lists of blocks with media, a tool's result in the midst of a message, and single blocks."""

    def message(x: Column, i: Column) -> Column:
        q = quoted(x["text"])
        lists = _say('[{"type":"text","text":~},{"type":"image_url","image_url":{"url":"u"}}]', q)
        split = _say('[{"type":"text","text":~},{"type":"tool_result","content":"r"},{"type":"thinking","text":"t"},~]', q, quoted(F.concat(x["text"], F.lit("!"))))
        content = F.when(i % 4 == 0, q).when(i % 4 == 1, lists).when(i % 4 == 2, split).otherwise(_say('{"text":~}', q))
        return _say('{"role":~,"content":~}', quoted(x["role"]), content)

    return _rows(_bodies(t, lambda c, turns: _say('{"model":"m","messages":[~],"system":[{"type":"text","text":~}]}', _joined(turns, message), quoted(F.concat(F.lit("S"), c)))), "anthropic_messages")


def response_items(t: Tables) -> DataFrame:
    """Responses bodies: plain texts, messages, calls and their outputs; every third one is an event of a web socket with the request within."""

    def entry(x: Column, i: Column) -> Column:
        said = _say('{"type":"message","role":~,"content":[{"type":"input_text","text":~}]}', quoted(x["role"]), quoted(x["text"]))
        return F.when(i % 5 == 1, quoted(x["text"])).when(i % 5 == 2, '{"type":"function_call","name":"f"}').when(i % 5 == 3, '{"type":"function_call_output","output":"o"}').otherwise(said)

    def body(c: Column, turns: Column) -> Column:
        own = _say('{"previous_response_id":~,"instructions":~,"input":[~]}', quoted(F.concat(F.lit("resp_"), c)), quoted(F.concat(F.lit("I"), c)), _joined(turns, entry))
        return F.when(c.cast("long") % 3 == 0, _say('{"type":"response.create","response":~}', own)).otherwise(own)

    return _rows(_bodies(t, body), "responses")


def gemini_items(t: Tables) -> DataFrame:
    """Gemini bodies: contents with media beside text, and requests within a request, two levels down."""

    def content(x: Column, i: Column) -> Column:
        role = F.when(x["role"] == "assistant", "model").otherwise("user")
        return _say('{"role":~,"parts":[{"text":~},{"inlineData":{"data":""}}]}', quoted(role), quoted(x["text"]))

    inner = '{"contents":{"parts":[{"text":"inner"}]},"requests":[{"instances":[{"prompt":"deep"},{}],"system_instruction":{"parts":"deep system"}}]}'
    return _rows(_bodies(t, lambda c, turns: _say('{"systemInstruction":{"parts":[{"text":~}]},"contents":[~],"requests":[' + inner + "]}", quoted(F.concat(F.lit("G"), c)), _joined(turns, content))), "gemini")


def embedding_items(t: Tables) -> DataFrame:
    """Embedding bodies: a list of texts and tokens, one text, or tokens alone."""

    def body(c: Column, turns: Column) -> Column:
        texts = _say('{"input":[1,~,[2]]}', _joined(turns, lambda x: quoted(x["text"])))
        return F.when(c.cast("long") % 3 == 0, texts).when(c.cast("long") % 3 == 1, _say('{"input":~}', quoted(turns[0]["text"]))).otherwise(F.lit('{"input":5}'))

    return _rows(_bodies(t, body), "openai_embeddings")


def media_items(t: Tables) -> DataFrame:
    """Media bodies: texts under known keys at several depths, data URLs and other keys."""
    made = '{"z":{"Text-Prompt":"data:image/png"},"prompt":~,"a":[{"negative_prompt":~,"url":"u"},"loose"],"size":1}'
    return _rows(_bodies(t, lambda c, turns: _say(made, quoted(turns[0]["text"]), quoted(F.concat(F.lit("not "), c)))), "openai_images")


def reply_streams(t: Tables) -> DataFrame:
    """Event streams of replies, a delta for each turn: the final object has the text in every third one, none in every fourth; a broken event in every fifth."""

    def body(c: Column, turns: Column) -> Column:
        n = c.cast("long")
        deltas = F.array_join(F.transform(turns, lambda x: _say('event: d\ndata: {"type":"response.output_text.delta","delta":~}\n', quoted(x["text"]))), "\n")
        done = 'data: {"type":"response.output_text.done","text":"late"}\n'
        refused = F.when(n % 6 == 1, 'data: {"type":"response.refusal.delta","delta":"no"}\r\n').otherwise("")
        final = F.when(n % 4 == 2, "").when(n % 3 == 0, 'data: {"type":"response.completed","response":{"id":"x","output":[{"content":[{"type":"output_text","text":"whole"}]}]}}\n').otherwise('data: {"type":"response.completed","response":{"id":"x","output":[]}}\n')
        created = _say('data: {"type":"response.created","response":{"id":"r~"}}\n', c)
        return F.concat(F.when(n % 4 == 2, "").otherwise(created), deltas, F.lit(done), refused, F.when(n % 5 == 4, "data: {oops\n").otherwise(""), final, F.lit("data: [DONE]\n"))

    by = t.turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = by.select("conv_id", body(F.col("conv_id").cast("string"), F.col("turns")).alias("body"))
    rows = rows.select("conv_id", protocol.response_id(F.col("body")).alias("response_id"), protocol.folded_stream(F.col("body")).alias("f"))
    return rows.select("conv_id", "response_id", "f.text", "f.refusal", "f.error", F.get_json_object("f.final", "$.id").alias("final_id"))


def form_texts(t: Tables) -> DataFrame:
    """Multipart bodies, a part for each turn: files (every fourth), bytes that are no UTF-8 (every fourth) and texts. Every seventh body isn't closed, and
    another one has bare line feeds."""
    turns = t.turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    c = F.col("conv_id").cast("string")
    bytes_of = lambda x: F.decode(x.cast("binary"), "ISO-8859-1")

    def part(x: Column, i: Column) -> Column:
        file = F.when(i % 4 == 1, '; filename="f.txt"').otherwise("")
        odd = F.when(i % 4 == 3, F.lit("\xff")).otherwise("")
        return F.concat(_say('--b~x\r\nContent-Disposition: form-data; name="~_~"~\r\nContent-Type: text/plain\r\n\r\n', c, x["role"], i.cast("string"), file), bytes_of(x["text"]), odd, F.lit("\r\n"))

    body = F.concat(F.lit("before\r\n"), F.array_join(F.transform("turns", part), ""), F.when(F.col("conv_id") % 7 == 3, "").otherwise(_say("--b~x--\r\nafter", c)))
    body = F.when(F.col("conv_id") % 7 == 5, F.replace(body, F.lit("\r\n"), F.lit("\n"))).otherwise(body)
    rows = turns.select("conv_id", F.encode(body, "ISO-8859-1").alias("body"), _say("b~x", c).alias("boundary"))
    found = rows.select("conv_id", F.posexplode(requests.form_texts(F.col("body"), F.col("boundary"))).alias("place", "field"))
    return found.select("conv_id", (F.col("place") + 1).cast("long").alias("place"), "field.name", "field.text")


_TURNS = "SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM turns WHERE conv_id % 7 NOT IN (3, 5)"
_NUMBERED = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i, k) - 1 AS place, role, origin, i AS message, texts, {previous} AS previous, media::BIGINT AS media FROM ({items})"
_ROLE = "CASE role WHEN 'system' THEN 'instruction' ELSE role END, CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'message' ELSE '' END"
_CONVS = "SELECT DISTINCT conv_id FROM turns WHERE conv_id % 7 NOT IN (3, 5)"


def _sql(items: str, previous: str = "''") -> str:
    return _NUMBERED.format(items=items, previous=previous)


REPORTS = [
    (
        "a6_message_items",
        message_items,
        _sql(
            f"SELECT conv_id, -1 AS i, 0 AS k, 'instruction' AS role, 'system' AS origin, 'S' || conv_id AS texts, 0 AS media FROM ({_CONVS}) "
            f"UNION ALL SELECT conv_id, i, 0, {_ROLE}, text, (i % 4 = 1)::INT FROM ({_TURNS}) UNION ALL SELECT conv_id, i, 1, 'tool', '', '', 0 FROM ({_TURNS}) WHERE i % 4 = 2 "
            f"UNION ALL SELECT conv_id, i, 2, {_ROLE}, text || '!', 0 FROM ({_TURNS}) WHERE i % 4 = 2"
        ),
    ),
    (
        "a7_response_items",
        response_items,
        _sql(
            f"SELECT conv_id, -1 AS i, 0 AS k, 'instruction' AS role, 'instructions' AS origin, 'I' || conv_id AS texts, 0 AS media FROM ({_CONVS}) "
            f"UNION ALL SELECT conv_id, i, 0, {_ROLE}, text, 0 FROM ({_TURNS}) WHERE i % 5 IN (0, 4) UNION ALL SELECT conv_id, i, 0, 'user', 'message', text, 0 FROM ({_TURNS}) WHERE i % 5 = 1 "
            f"UNION ALL SELECT conv_id, i, 0, CASE i % 5 WHEN 2 THEN 'assistant' ELSE 'tool' END, '', '', 0 FROM ({_TURNS}) WHERE i % 5 IN (2, 3)",
            "'resp_' || conv_id",
        ),
    ),
    (
        "a8_gemini_items",
        gemini_items,
        "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k, i) - 1 AS place, role, origin, i AS message, texts, '' AS previous, media::BIGINT AS media FROM ("
        f"SELECT conv_id, -1 AS i, 0 AS k, 'instruction' AS role, 'system' AS origin, 'G' || conv_id AS texts, 0 AS media FROM ({_CONVS}) UNION ALL SELECT conv_id, -1, 1, 'instruction', 'system', 'deep system', 0 FROM ({_CONVS}) "
        f"UNION ALL SELECT conv_id, i, 2, CASE role WHEN 'assistant' THEN role ELSE 'user' END, CASE role WHEN 'assistant' THEN '' ELSE 'message' END, text, 1 FROM ({_TURNS}) "
        f"UNION ALL SELECT conv_id, 0, 3, 'user', 'message', 'inner', 0 FROM ({_CONVS}) UNION ALL SELECT conv_id, 0, 4, 'user', 'message', 'deep', 0 FROM ({_CONVS}))",
    ),
    (
        "a9_embedding_items",
        embedding_items,
        f"SELECT conv_id, 0 AS place, 'user' AS role, 'message' AS origin, 0 AS message, string_agg(text, '|' ORDER BY i) AS texts, '' AS previous, 0::BIGINT AS media FROM ({_TURNS}) WHERE conv_id % 3 = 0 OR conv_id % 3 = 1 AND i = 0 GROUP BY conv_id",
    ),
    ("a10_media_items", media_items, f"SELECT conv_id, 0 AS place, 'user' AS role, 'message' AS origin, 0 AS message, 'not ' || conv_id || '|' || text AS texts, '' AS previous, 0::BIGINT AS media FROM ({_TURNS}) WHERE i = 0"),
    (
        "a12_form_texts",
        form_texts,
        "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS place, role || '_' || i AS name, CASE WHEN conv_id % 7 = 5 THEN replace(text, chr(13) || chr(10), chr(10)) ELSE text END AS text FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM turns WHERE conv_id % 7 <> 3) WHERE i % 4 IN (0, 2)",
    ),
    (
        "a14_reply_streams",
        reply_streams,
        "SELECT conv_id, CASE WHEN conv_id % 4 <> 2 THEN 'r' || conv_id END AS response_id, CASE WHEN error IS NULL AND NOT (refused AND NOT own) THEN CASE WHEN own THEN 'whole' ELSE said END END AS text, CASE WHEN error IS NULL AND refused AND NOT own THEN 'no' END AS refusal, error, CASE WHEN error IS NULL THEN 'x' END AS final_id "
        "FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS said, CASE WHEN conv_id % 5 = 4 THEN 'invalid_event' WHEN conv_id % 4 = 2 THEN 'no_final' END AS error, conv_id % 3 = 0 AND conv_id % 4 <> 2 AS own, conv_id % 6 = 1 AS refused FROM turns GROUP BY conv_id)",
    ),
]
