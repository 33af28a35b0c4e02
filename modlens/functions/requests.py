"""Request bodies of the protocol families as prompt items, by column functions over VARIANT.

decode(protocol, body) gives struct<model, previous, items>; an item is (role, origin, message, parts) with role one of
instruction, user, assistant, tool, message the place of its message (-1 for top-level instructions), and parts of
(text, media). A body that isn't one JSON object, repeats a key, or breaks its protocol's types gives null, so that
it makes no rows and stops no job. Everything is an expression over the body's own row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<text:string,media:boolean>"
ITEM = f"struct<role:string,origin:string,message:int,parts:array<{PART}>>"
PIECE = "struct<kind:string,text:string>"

# --- fixed values: names that requests use ---------------------------------------------------------------------------
TOOL_BLOCKS = ("tool_result", "function_call_output", "custom_tool_call_output")
OTHER_BLOCKS = ("tool_use", "thinking", "redacted_thinking", "server_tool_use", "web_search_tool_result")
TEXT_BLOCKS = ("text", "input_text", "output_text")
MEDIA_BLOCKS = ("image", "image_url", "input_image", "input_audio", "audio", "video", "input_video", "file", "input_file")
MEDIA_KEYS = ("inlineData", "inline_data", "fileData", "file_data", "image_url", "input_audio", "file", "source")
ROLES = {"system": "instruction", "developer": "instruction", "user": "user", "assistant": "assistant", "model": "assistant", "tool": "tool", "function": "tool"}
ORIGINS = {"system": "system", "developer": "developer", "user": "message"}
NO_ITEM = ("additional_tools", "item_reference")
ASSISTANT_ITEMS = ("reasoning", "compaction", "agent_message")
PROMPT_KEYS = (
    "prompt", "inputprompt", "textprompt", "description", "query", "lyrics", "negativeprompt", "positiveprompt", "gptdescriptionprompt", "prompten", "finalprompt", "finalzhprompt",
    "origprompt", "actualprompt", "imageprompt", "input", "text",
)
PROTOCOLS = {
    "responses": ("responses", "openai_responses", "responses_websocket"),
    "messages": ("chat_completions", "openai_chat_completions", "openai_chat", "anthropic_messages", "claude_messages", "messages"),
    "gemini": ("gemini", "gemini_generate_content"),
    "embeddings": ("openai_embeddings",),
    "media": ("openai_alpha_search", "openai_images", "grok_media", "media", "images"),
}
# --- end of fixed values ----------------------------------------------------------------------------------------------

#: Levels of a media request that are walked, and of requests within Gemini requests.
DEEPEST = 32


# --- VARIANT ----------------------------------------------------------------------------------------------------------


def whole(body: Column) -> Column:
    """The body as a VARIANT, null unless it is one JSON value and nothing else; repeated keys make it null as well."""
    found = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_text(v: Column) -> Column:
    """Whether it is a string. Lists and objects are told apart first, as the schema of a large one is dear."""
    return F.coalesce(as_list(v).isNull() & as_map(v).isNull() & (F.schema_of_variant(v) == "STRING"), F.lit(False))


def absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def text_of(v: Column) -> Column:
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def _piece(kind: str, text: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if text is None else text).alias("text"))


def _none(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def walk(v: Column, within: Callable[[Column], Column]) -> Column:
    """Everything in v that within() finds, v itself first and each before what is in it: an array of struct<path, v, text>. within(x) gives an array
    of struct<v, text>, of which those with a v are looked into, DEEPEST levels down."""
    node = "struct<path:array<int>,v:variant,text:string>"

    def deeper(state: Column, _level: Column) -> Column:
        looked = F.filter(state["last"], lambda x: x["v"].isNotNull())
        found = F.flatten(F.transform(looked, lambda p: F.transform(within(p["v"]), lambda c, i: F.struct(F.concat(p["path"], F.array(i)).alias("path"), c["v"].alias("v"), c["text"].alias("text")))))
        return F.struct(F.concat(state["all"], state["last"]).alias("all"), found.alias("last"))

    top = F.array(F.struct(F.array().cast("array<int>").alias("path"), v.alias("v"), F.lit(None).cast("string").alias("text")))
    start = F.struct(F.array().cast(f"array<{node}>").alias("all"), top.alias("last"))
    every = F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), start, deeper, lambda s: F.concat(s["all"], F.filter(s["last"], lambda x: x["v"].isNull())))
    return F.array_sort(every, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))


# --- content ----------------------------------------------------------------------------------------------------------


def block(b: Column) -> Column:
    """A content block as (kind, text): text, media, tool (a result, which splits its message), other, or bad."""
    kind, text, fields = get(b, "type"), get(b, "text"), as_map(b)
    name = F.coalesce(text_of(kind), F.lit(""))
    said = F.when(absent(text), _piece("other")).otherwise(_piece("text", text_of(text)))
    of_document = F.when(text_of(get(get(b, "source"), "type")) == "text", _piece("text", F.coalesce(text_of(get(get(b, "source"), "data")), F.lit("")))).otherwise(_piece("media"))
    has = F.arrays_overlap(F.map_keys(fields), F.array(*map(F.lit, MEDIA_KEYS)))
    return (
        F.when(is_text(b), _piece("text", text_of(b)))
        .when(F.is_variant_null(b), _piece("other"))
        .when(fields.isNull() | ~(absent(kind) | is_text(kind)) | ~(absent(text) | is_text(text)), _piece("bad"))
        .when(name.isin(*TOOL_BLOCKS), _piece("tool"))
        .when(name.isin(*OTHER_BLOCKS), _piece("other"))
        .when(name.isin(*TEXT_BLOCKS), said)
        .when(name == "document", of_document)
        .when(name.isin(*MEDIA_BLOCKS), _piece("media"))
        .when(get(b, "functionResponse").isNotNull(), _piece("tool"))
        .when(get(b, "functionCall").isNotNull(), _piece("other"))
        .when(~absent(text), _piece("text", text_of(text)))
        .when(has, _piece("media"))
        .otherwise(_piece("other"))
    )


def pieces(content: Column) -> Column:
    """The blocks of a content value: a text, a block, a list of both, or nothing."""
    blocks = F.when(as_list(content).isNotNull(), as_list(content)).otherwise(F.array(content))
    return F.when(absent(content), _none(PIECE)).otherwise(F.transform(blocks, block))


def sound(found: Column) -> Column:
    return ~F.exists(found, lambda p: p["kind"] == "bad")


def item(role: Column | str, origin: Column | str, message: Column, parts: Column) -> Column:
    role, origin = (F.lit(x) if isinstance(x, str) else x for x in (role, origin))
    return F.struct(role.alias("role"), origin.alias("origin"), message.cast("int").alias("message"), parts.alias("parts"))


def split(role: Column | str, origin: Column | str, message: Column, found: Column) -> Column:
    """A message's blocks as items in order: a tool's result is an item of its own and parts those beside it. An assistant's message without content keeps its place."""
    tool = item("tool", "", message, _none(PART))

    def flushed(parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.array(item(role, origin, message, parts))).otherwise(_none(ITEM))

    def step(state: Column, p: Column) -> Column:
        part = F.struct(p["text"].alias("text"), (p["kind"] == "media").alias("media"))
        ended = F.struct(F.concat(state["items"], flushed(state["parts"]), F.array(tool)).alias("items"), _none(PART).alias("parts"))
        longer = F.struct(state["items"].alias("items"), F.concat(state["parts"], F.array(part)).alias("parts"))
        return F.when(p["kind"] == "tool", ended).when(p["kind"] == "other", state).otherwise(longer)

    start = F.struct(_none(ITEM).alias("items"), _none(PART).alias("parts"))
    keeps = ~(F.lit(role) if isinstance(role, str) else role).isin("user", "instruction")

    def ended(s: Column) -> Column:
        items = F.concat(s["items"], flushed(s["parts"]))
        return F.when(keeps & (F.size(items) == 0), F.array(item(role, origin, message, _none(PART)))).otherwise(items)

    return F.aggregate(found, start, step, ended)


def _looked_up(names: dict[str, str], name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[name]


def _plain(text: Column) -> Column:
    """A text as a user's message of its own."""
    return F.array(F.struct(text.alias("text"), F.lit(False).alias("media")))


def _result(v: Column, valid: Column, items: Column, previous: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    made = F.struct(text_of(get(v, "model")).alias("model"), (none if previous is None else previous).alias("previous"), items.alias("items"))
    return F.when(F.coalesce(as_map(v).isNotNull() & valid, F.lit(False)), made)


# --- protocols ----------------------------------------------------------------------------------------------------------


def _messages(listed: Column, role: Callable[[Column], Column], content: str) -> Column:
    """For each message its items, or null if its role or its content can't be read."""

    def items(m: Column, i: Column) -> Column:
        def of(x: Column) -> Column:
            said = split(x["of"], x["origin"], i, x["found"])
            return F.when(x["of"].isNotNull() & sound(x["found"]), F.when(x["of"] == "tool", F.array(item("tool", "", i, _none(PART)))).otherwise(said))

        return let(F.struct(_looked_up(ROLES, role(m)).alias("of"), F.coalesce(_looked_up(ORIGINS, role(m)), F.lit("")).alias("origin"), pieces(get(m, content)).alias("found")), of)

    return F.transform(listed, items)


def _whole(found: Column) -> Column:
    """Whether all items could be made."""
    return F.coalesce(~F.exists(found, lambda x: x.isNull()), F.lit(False))


def of_messages(v: Column) -> Column:
    """Chat Completions and Messages: a top-level system and a list of messages."""
    found = F.struct(pieces(get(v, "system")).alias("top"), _messages(as_list(get(v, "messages")), lambda m: text_of(get(m, "role")), "content").alias("said"))
    return let(found, lambda x: _result(v, sound(x["top"]) & _whole(x["said"]), F.concat(split("instruction", "system", F.lit(-1), x["top"]), F.flatten(x["said"]))))


def _entry(e: Column, i: Column) -> Column:
    """The items of an input entry, or null if it can't be read."""
    kind, role = F.coalesce(text_of(get(e, "type")), F.lit("")), F.coalesce(text_of(get(e, "role")), F.lit(""))
    odd = as_map(e).isNull() | ~(absent(get(e, "type")) | is_text(get(e, "type"))) | ~(absent(get(e, "role")) | is_text(get(e, "role")))

    def of(x: Column) -> Column:
        kind, role = x["kind"], F.when(x["role"] == "", "user").otherwise(x["role"])
        return (
            F.when(x["text"].isNotNull(), F.array(item("user", "message", i, _plain(x["text"]))))
            .when(x["null"], _none(ITEM))
            .when(x["odd"] | ~sound(x["found"]), F.lit(None).cast(f"array<{ITEM}>"))
            .when(kind.isin(*NO_ITEM), _none(ITEM))
            .when(kind.endswith("_output") | (kind == "tool_result"), F.array(item("tool", "", i, _none(PART))))
            .when(kind.endswith("_call") | kind.isin(*ASSISTANT_ITEMS), F.array(item("assistant", "", i, _none(PART))))
            .when(~kind.isin("", "message") & (x["role"] == ""), _none(ITEM))
            .when(_looked_up(ROLES, role) == "tool", F.array(item("tool", "", i, _none(PART))))
            .when(_looked_up(ROLES, role).isNotNull(), split(_looked_up(ROLES, role), F.coalesce(_looked_up(ORIGINS, role), F.lit("")), i, x["found"]))
        )

    fields = {"text": text_of(e), "null": F.is_variant_null(e), "odd": odd, "kind": kind, "role": role, "found": pieces(get(e, "content"))}
    return let(F.struct(*[c.alias(k) for k, c in fields.items()]), of)


def of_responses(v: Column, websocket: bool = False, nested: bool = True) -> Column:
    """Responses: instructions and input, a text, an entry or a list of them. An event of a web socket must be response.create,
    and may hold the request in `response`, which holds no other."""
    entry = get(v, "input")
    listed = (
        F.when(absent(entry), F.array().cast("array<variant>"))
        .when(as_list(entry).isNotNull(), as_list(entry))
        .when(is_text(entry) | as_map(entry).isNotNull(), F.array(entry))
    )
    found = F.struct(F.coalesce(text_of(get(v, "type")), F.lit("")).alias("kind"), pieces(get(v, "instructions")).alias("top"), F.transform(listed, _entry).alias("said"))

    def made(x: Column) -> Column:
        event = F.lit(True) if websocket else x["kind"] != ""
        items = F.concat(split("instruction", "instructions", F.lit(-1), x["top"]), F.flatten(x["said"]))
        return _result(v, (~event | (x["kind"] == "response.create")) & sound(x["top"]) & _whole(x["said"]), items, text_of(get(v, "previous_response_id")))

    own = let(found, made)
    if not nested:
        return own

    def merged(within: Column) -> Column:
        model, previous = (F.coalesce(_named(within[x]), text_of(get(v, y))) for x, y in (("model", "model"), ("previous", "previous_response_id")))
        return F.when(within.isNotNull(), F.struct(model.alias("model"), previous.alias("previous"), within["items"].alias("items")))

    inner = (text_of(get(v, "type")) == "response.create") & entry.isNull() & get(v, "response").isNotNull()
    return F.when(F.coalesce(inner, F.lit(False)), let(of_responses(get(v, "response"), nested=False), merged)).otherwise(own)


def _named(text: Column) -> Column:
    return F.when(text != "", text)


def _gemini_contents(v: Column) -> Column:
    """The values of content and contents, each a list of content objects; null if one of them is neither list nor object."""

    def listed(key: str) -> Column:
        c = get(v, key)
        return F.when(absent(c), F.array().cast("array<variant>")).when(as_list(c).isNotNull(), as_list(c)).when(as_map(c).isNotNull(), F.array(c))

    return F.concat(listed("content"), listed("contents"))


def of_gemini(v: Column) -> Column:
    """Gemini: systemInstruction, contents (a list or one object), instances with a prompt, and requests within the request, DEEPEST levels of
    them. Instructions of all levels come first; a request's own contents come before those within it."""

    def system(r: Column) -> Column:
        return F.coalesce(*[F.when(~absent(get(r, k)), get(r, k)) for k in ("systemInstruction", "system_instruction")])

    def role(c: Column) -> Column:
        named = get(c, "role")
        said = F.when(absent(named), "user").otherwise(F.when(text_of(named) == "", "user").otherwise(text_of(named)))
        return F.when(as_map(c).isNotNull() | F.is_variant_null(c), said)

    def instance_fits(x: Column) -> Column:
        return F.coalesce(F.is_variant_null(x) | as_map(x).isNotNull() & (absent(get(x, "prompt")) | is_text(get(x, "prompt"))), F.lit(False))

    def a_list(c: Column) -> Column:
        return c.isNull() | as_list(c).isNotNull()

    def node(r: Column) -> Column:
        """Instructions and items of one request, or null if it can't be read."""
        fields = {"system": pieces(get(system(r), "parts")), "said": _messages(_gemini_contents(r), role, "parts"), "instances": as_list(get(r, "instances"))}

        def of(x: Column) -> Column:
            s = system(r)
            good = as_map(r).isNotNull() & (s.isNull() | as_map(s).isNotNull()) & sound(x["system"]) & _whole(x["said"]) & a_list(get(r, "instances")) & a_list(get(r, "requests"))
            instances = F.coalesce(F.flatten(F.transform(x["instances"], instance_items)), _none(ITEM))
            made = F.struct(split("instruction", "system", F.lit(-1), x["system"]).alias("top"), F.concat(F.flatten(x["said"]), instances).alias("said"))
            return F.when(F.coalesce(good & F.coalesce(F.forall(x["instances"], instance_fits), F.lit(True)), F.lit(False)), made)

        return let(F.struct(*[c.alias(k) for k, c in fields.items()]), of)

    def instance_items(x: Column, i: Column) -> Column:
        return F.when(absent(get(x, "prompt")), _none(ITEM)).otherwise(F.array(item("user", "message", i, _plain(text_of(get(x, "prompt"))))))

    def of_nodes(nodes: Column) -> Column:
        tops, said = (F.flatten(nodes.getField(k)) for k in ("top", "said"))
        return _result(v, _whole(nodes), F.concat(tops, said))

    def within(r: Column) -> Column:
        return F.transform(F.coalesce(as_list(get(r, "requests")), F.array().cast("array<variant>")), lambda x: F.struct(x.alias("v"), F.lit(None).cast("string").alias("text")))

    return let(F.transform(walk(v, within), lambda x: node(x["v"])), of_nodes)


def _user_parts(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.array(item("user", "message", F.lit(0), parts))).otherwise(_none(ITEM))


def of_embeddings(v: Column) -> Column:
    """Embeddings: a text or the texts of a list, as one message; lists of tokens hold no text."""
    entry = get(v, "input")
    texts = F.transform(F.filter(as_list(entry), is_text), lambda x: F.struct(text_of(x).alias("text"), F.lit(False).alias("media")))
    parts = F.when(is_text(entry), _plain(text_of(entry))).otherwise(F.coalesce(texts, _none(PART)))
    return _result(v, F.lit(True), _user_parts(parts))


def of_media(v: Column) -> Column:
    """Media and search: texts under the known keys, by keys in their order, DEEPEST levels down; with messages, a request of those. Data URLs
    are no texts."""

    def known(key: Column) -> Column:
        return F.regexp_replace(F.lower(key), "[_-]", "").isin(*PROMPT_KEYS)

    def within(x: Column) -> Column:
        none = F.lit(None).cast("string")
        fields = as_map(x)

        def of_key(k: Column) -> Column:
            said = known(k) & is_text(fields[k])
            return F.struct(F.when(~said, fields[k]).alias("v"), F.when(said, text_of(fields[k])).alias("text"))

        listed = F.transform(as_list(x), lambda e: F.struct(e.alias("v"), none.alias("text")))
        return F.coalesce(listed, F.transform(F.array_sort(F.map_keys(fields)), of_key), F.array().cast("array<struct<v:variant,text:string>>"))

    found = F.filter(F.transform(walk(v, within), lambda x: x["text"]), lambda t: t.isNotNull() & ~t.startswith("data:"))
    parts = F.transform(found, lambda t: F.struct(t.alias("text"), F.lit(False).alias("media")))
    return F.when(get(v, "messages").isNotNull(), of_messages(v)).otherwise(_result(v, F.lit(True), _user_parts(parts)))


DECODERS: dict[str, Callable[[Column], Column]] = {"responses": of_responses, "messages": of_messages, "gemini": of_gemini, "embeddings": of_embeddings, "media": of_media}


def decode(protocol: str, body: Column) -> Column:
    """struct<model, previous, items> of bodies of one protocol, by any of its names; null for a null or odd body."""
    family = next((f for f, names in PROTOCOLS.items() if protocol.lower() in names), None)
    if family is None:
        raise ValueError(f"no such protocol: {protocol}")
    of = partial(of_responses, websocket=True) if protocol.lower() == "responses_websocket" else DECODERS[family]
    return let(whole(body), lambda v: of(v))  # a lambda, as transform() looks at how many arguments a function has


def prompt_items(bodies: DataFrame, protocol: str, body: str = "body", *keep: str) -> DataFrame:
    """A row for each item of each body: the columns named in keep, place (from 0), role, origin, message, texts,
    previous (the response that it goes on from), media (how many parts are)."""
    found = bodies.select(*keep, decode(protocol, F.col(body)).alias("decoded")).where("decoded IS NOT NULL")
    rows = found.select(*keep, F.col("decoded.previous").alias("previous"), F.posexplode("decoded.items").alias("place", "item"))
    texts = F.transform(F.filter("item.parts", lambda p: ~p["media"]), lambda p: p["text"])
    return rows.select(*keep, F.col("place").cast("long").alias("place"), "item.role", "item.origin", F.col("item.message").cast("long").alias("message"), texts.alias("texts"), "previous", F.size(F.filter("item.parts", lambda p: p["media"])).cast("long").alias("media"))


# --- forms --------------------------------------------------------------------------------------------------------------


def form_texts(body: Column, boundary: Column) -> Column:
    """The text fields of a multipart body (binary), in order: array<struct<name, text>>; null without a boundary or its closing line.

    Parts with a file name are left out, as are those whose bytes aren't UTF-8. Lines may end in \\r\\n or \\n. Bytes go through as Latin-1 characters, so
    that text functions can cut them. A part without a header of its own name has the name ''.
    """
    wide = F.concat(F.lit("\r\n"), F.decode(body, "ISO-8859-1"))
    cut = F.concat(F.lit(r"\r?\n--\Q"), boundary, F.lit(r"\E(?=--|[ \t]*\r?\n)"))
    segments = F.split(wide, cut)

    def part(segment: Column) -> Column:
        rest = F.regexp_replace(segment, r"\A[ \t]*\r?\n", "")
        head = F.regexp_extract(rest, r"\A((?:[^\r\n]+\r?\n)*)\r?\n", 1)
        content = F.regexp_replace(rest, r"\A(?:[^\r\n]+\r?\n)*\r?\n", "")
        line = F.regexp_extract(head, r"(?im)^content-disposition:(.*)$", 1)
        quoted = [F.regexp_extract(line, rf'(?i);\s*{x}=(?:"((?:[^"\\]|\\.)*)"|([^;\s"]+))', i) for x in ("name", "filename") for i in (1, 2)]
        name, file = (F.concat(quoted[k], quoted[k + 1]) for k in (0, 2))
        named = F.when(line.rlike(r"(?i)^\s*form-data\s*(;|$)"), name).otherwise("")
        as_text = lambda x: F.encode(x, "ISO-8859-1").cast("string")
        return F.struct(as_text(named).alias("name"), as_text(content).alias("text"), (file != "").alias("file"))

    def parts(found: Column) -> Column:
        # the last line of the form begins the first segment with two dashes
        end = F.array_position(F.transform(found, lambda x: x.startswith("--")), F.lit(True)).cast("int")
        kept = F.filter(F.transform(F.slice(found, 2, F.greatest(end - 2, F.lit(0))), part), lambda p: ~p["file"] & F.is_valid_utf8(p["text"]))
        return F.when(end > 1, F.transform(kept, lambda p: F.struct(p["name"].alias("name"), p["text"].alias("text"))))

    return F.when(boundary != "", let(segments, parts))
