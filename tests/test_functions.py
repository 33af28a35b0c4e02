"""Column functions, folds and small parsers against stated cases."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from modlens.functions import conversation, decisions, diff, protocol, score, text
from modlens.operators import filters, relational, similar
from modlens.plans import lifecycle
from modlens.sources import sinks
from modlens.streaming import folds, streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


VOTES = [
    # rule, blocks, reviews, failures, skipped, nodes -> decision, partial, failure
    ("majority_block", 1, 0, 1, 0, 3, None, True, "audit_unavailable"),
    ("all_block", 1, 0, 1, 0, 3, "review", True, None),
    ("any_block", 1, 0, 1, 0, 3, "block", True, None),
    ("majority_block", 2, 0, 0, 0, 3, "block", False, None),
    ("all_block", 0, 0, 0, 1, 2, None, False, "invalid_model_result"),
    ("any_block", 0, 1, 0, 0, 3, "review", False, None),
    ("any_block", 0, 0, 0, 0, 3, "pass", False, None),
    ("any_block", 0, 0, 0, 0, 0, None, False, "no_models"),
]


@pytest.mark.parametrize("case", VOTES)
def test_votes(spark, case):
    rule, *counts = case[:6]
    got = one(spark, decisions.vote_outcome(rule, *[F.lit(c) for c in counts]))
    assert (got["decision"], got["partial"], got["failure"]) == case[6:]


def test_unknown_rule():
    with pytest.raises(ValueError):
        decisions.block_threshold("most", F.lit(1))


def test_thresholds(spark):
    assert [one(spark, decisions.classify(F.lit(x), 0.5, 0.8)) for x in (0.1, 0.6, 0.8, None)] == ["pass", "review", "block", None]


@pytest.mark.parametrize(
    ("reason", "declared", "codes"),
    [
        ("违规/R01、R02：text", None, ["R01", "R02"]),
        ("待复核/R03,R03 R1/R04: x", None, ["R03", "R04"]),
        ("指令风险/R05，R06：x", ["R06"], ["R06"]),
        ("违规/R01", None, None),
        ("正常：R01", None, None),
        ("：违规/R01", None, None),
        (None, None, None),
    ],
)
def test_reason_codes(spark, reason, declared, codes):
    d = F.array(*[F.lit(x) for x in declared]) if declared else None
    assert one(spark, decisions.reason_codes(F.lit(reason).cast("string"), d)) == codes


def test_policy_names(spark):
    assert one(spark, decisions.policy_names(F.lit("intro\n R01 First \nR02 Second\nR01 Last\nR3 no"))) == {"R01": "Last", "R02": "Second"}


def test_disposition(spark):
    rules = {"R01": "notice_only", "R02": "immediate_disable"}
    arr = lambda *c: F.array(*[F.lit(x) for x in c]).cast("array<string>")
    assert [one(spark, decisions.disposition(arr(*c), rules)) for c in (("R01", "R02"), ("R01",), ("R03",), ())] == ["immediate_disable", "notice_only", "", ""]


def test_delays(spark):
    assert [one(spark, decisions.auto_retry_minutes(F.lit(n))) for n in (0, 1, 2, 9)] == [1, 5, 15, 15]
    assert [one(spark, decisions.cooldown_s(F.lit(n))) for n in (1, 2, 3, 9)] == [15, 30, 60, 300]
    assert one(spark, decisions.auth_failure(F.lit(None).cast("string"), F.lit("upstream http 403")))


def test_round_decision(spark):
    rows = [(1, 1, "instruction", "review"), (1, 2, "user", "block"), (2, 1, "user", "block"), (2, 2, "instruction", None), (3, 1, "user", None), (3, 2, "user", None), (4, 1, "instruction", "review"), (4, 2, "user", "review")]
    got = {r["job_id"]: (r["decision"], r["kind"]) for r in lifecycle.round_decision(spark.createDataFrame(rows, "job_id int, target_order int, kind string, decision string")).collect()}
    assert got == {1: ("block", "user"), 2: ("block", "user"), 3: (None, None), 4: ("review", "user")}


def test_texts(spark):
    assert one(spark, text.normalise(F.lit("\u3000 a\r\nb\rc\x00 \u00a0\u0085"))) == "a\nb\nc\ufffd"
    assert one(spark, text.content_hash(F.lit("user"), F.lit("x"))) == __import__("hashlib").sha256(b"user\0x").hexdigest()
    for t in ("plain", "nul\0", '{"encoding": "x"}'):
        assert one(spark, text.open_envelope(F.lit(text.to_envelope(t)))) == t
    assert one(spark, text.open_envelope(F.lit('{"encoding":"base64","data":"%%"}'))) == '{"encoding":"base64","data":"%%"}'
    assert one(spark, text.csv_guard(F.lit("=1"))) == "'=1"


def test_simhash():
    fnv = lambda s: __import__("functools").reduce(lambda h, b: ((h ^ b) * 0x100000001B3) % 2**64, s.encode(), 0xCBF29CE484222325)
    assert [int(x) for x in text.fnv1a(["", "abc", "été"])] == [fnv("abc"[:0]), fnv("abc"), fnv("été")]
    assert text.features("Ab-c 你好 は x_1 한국") == ["ab-c", "你", "你好", "好", "は", "x_1"]
    base = "the system prompt asks for short and careful answers in every case " * 4
    near, far = base.replace("short", "brief", 1), "completely different words about trains, boats and rivers " * 4
    d = lambda a, b: bin((text.simhash(a) ^ text.simhash(b)) % 2**64).count("1")
    assert d(base, near) < d(base, far) and text.simhash("") == 0 and text.simhash(None) is None


def test_similar_pairs_miss_none(spark):
    import random

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = []
    for b in base:
        for k in range(5):
            v = b
            for bit in rng.sample(range(64), k):
                v ^= 1 << bit
            values.append(v - 2**64 if v >= 2**63 else v)
    df = spark.createDataFrame([*enumerate(values), (900, None), (901, values[0])], "id long, simhash long")
    got = {(r["a"], r["b"], r["distance"]) for r in similar.similar_pairs(df, df).collect()}
    all_ = [*enumerate(values), (901, values[0])]
    want = {(i, j, bin((x ^ y) % 2**64).count("1")) for i, x in all_ for j, y in all_ if i != j and bin((x ^ y) % 2**64).count("1") <= 3}
    assert got == want


def test_paths_and_clients(spark):
    paths = ["/v1/responses/x", "/v1/chat/completions", "/v1/messages", "/v1/models/m:streamGenerateContent", "/v1/embeddings", "/v1/images/x", "/tts", "/alpha/search", "/x"]
    assert [one(spark, protocol.protocol(F.lit(p))) for p in paths] == ["responses", "chat_completions", "anthropic_messages", "gemini", "openai_embeddings", "media", "media", "openai_alpha_search", "unsupported"]
    assert one(spark, protocol.client(F.lit("curl"), F.lit("codex_cli_rs"))) == "codex" and one(spark, protocol.client(F.lit(None).cast("string"))) == "generic"


def test_replies(spark):
    stream = 'event: x\ndata: {"type":"response.created","response":{"id":"r1"}}\ndata: [DONE]\n'
    assert one(spark, protocol.response_id(F.lit(stream))) == "r1" and one(spark, protocol.response_id(F.lit('{"id":"q"}'))) == "q"
    chat = 'data: {"choices":[{"delta":{"role":"assistant"}}]}\n\ndata: {"choices":[{"delta":{"content":"Hel"}}]}\r\ndata: {"choices":[{"delta":{"content":"lo"}}]}\ndata: [DONE]'
    assert one(spark, protocol.chat_stream_text(F.lit(chat))) == "Hello"


@pytest.mark.parametrize(
    ("reply", "error"),
    [('{"confidence":0.5,"reason":"x"}', None), ('```json\n{"confidence":1,"reason":""}\n```', None), ('{"confidence":0.5,"confidence":0.6,"reason":"x"}', "duplicate_key"), ('{"confidence":1.5,"reason":"x"}', "invalid_confidence"), ('{"confidence":true,"reason":"x"}', "invalid_confidence"), ('{"confidence":0.5,"reason":"x"} more', "invalid_json"), ('{"confidence":0.5}', "invalid_reason"), ("[]", "invalid_json"), (None, "empty")],
)
def test_score_contract(spark, reply, error):
    assert one(spark, score.score_contract(F.lit(reply).cast("string")))["error"] == error


def test_table_functions(spark):
    diff.register(spark)
    assert [(r["op"], r["text"]) for r in spark.sql("SELECT * FROM line_diff('a\\nb\\nc', 'a\\nx\\nc') ORDER BY place").collect()] == [("same", "a"), ("del", "b"), ("add", "x"), ("same", "c")]


def test_diff_folds_equal_lines():
    lines = [f"line {i}" for i in range(800)]
    changed = [*lines[:400], "new", *lines[400:]]
    rows = diff.line_diff("\n".join(lines), "\n".join(changed))
    assert [r[0] for r in rows] == ["skip", *["same"] * 3, "add", *["same"] * 3, "skip"] and rows[0][3] == "397"
    assert [r[0] for r in diff.line_diff("same", "same")] == ["skip"]
    assert {r[0] for r in diff.line_diff("\n".join(map(str, range(600))), "\n".join(map(str, range(600, 1200))))} == {"del", "add"}


def test_turns(spark):
    rows = [
        (1, 0, "system", "S"), (1, 1, "user", "old"), (1, 2, "assistant", "x"), (1, 3, "user", "a "), (1, 4, "user", "b"), (1, 5, "assistant", "pre"), (1, 6, "system", "S"),
        (2, 0, "user", "q"), (2, 1, "assistant", "call"), (2, 2, "tool", "t"), (3, 0, "assistant", "only"),
    ]
    got = {r["conv_id"]: r for r in conversation.turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    h = lambda kind, t: __import__("hashlib").sha256(f"{kind}\0{t}".encode()).hexdigest()
    assert (got[1]["user_hash"], got[1]["continuation"], got[1]["instructions"]) == (h("user", "a\n\nb"), False, 1)
    assert (got[2]["user_hash"], got[2]["continuation"]) == (h("user", "q"), True)
    assert got[3]["user_hash"] == ""


def test_filters(spark):
    with pytest.raises(ValueError):
        filters.JobFilter(decision="maybe").check()
    with pytest.raises(ValueError):
        filters.JobFilter(category="1").check()
    with pytest.raises(ValueError):
        filters.JobFilter(since="2024-01-02", until="2024-01-01").check()
    assert filters.split_query(" #42 ") == {"job_id": 42} and filters.split_query("abc") == {"request_id": "abc"} and filters.split_query("") == {}
    jobs = spark.createDataFrame([(1, ["R01"]), (2, None), (3, [])], "id long, trigger_categories array<string>")
    assert [r["id"] for r in filters.JobFilter(category="R01").apply(jobs).collect()] == [1]
    assert filters.JobFilter().apply(jobs).count() == 3


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    assert sorted(map(str, relational.upsert(t, spark.createDataFrame([(1, "c"), (None, "d")], t.schema), ["k"]).collect())) == ["Row(k=1, v='c')", "Row(k=None, v='d')"]
    assert relational.insert_new(t.where("k = 1"), spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], t.schema), "k").count() == 2
    assert [relational.page(spark.range(10), [F.asc("id")], n, 3).count() for n in (-1, 1, 4, 5)] == [3, 3, 1, 0]


def test_bodies(spark):
    df = spark.createDataFrame([(gzip.compress(b"x"), "gzip"), (b"x", None), (b"x", "gzip"), (b"x", "br"), (None, None)], "body binary, encoding string")
    assert [r["x"] for r in df.select(sinks.decompressed("body", "encoding").alias("x")).collect()] == [bytearray(b"x"), bytearray(b"x"), None, None, None]
    assert sinks.inflate_body(gzip.compress(b"0" * (sinks.MOST_BODY + 1)), "gzip") is None


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, '=cmd,"q"\nx', None), (2, None, 0.25)], "id int, note string, score double")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert sorted((r["id"], r["note"], r["score"]) for r in back.collect()) == [("1", "'=cmd,\"q\"\nx", None), ("2", None, "0.2500")]


# --- folds -----------------------------------------------------------------------------------------------------------


def run(fold, records):
    state, out = {}, []
    for r in records:
        state, made = fold(state, r)
        out += made
    return out


def job(i, bad, mode="async", role="user", disposition=""):
    return {"id": i, "user_id": 1, "eligible": True, "violation": bad, "run_mode": mode, "role": role, "disposition": disposition}


def test_enforcement():
    acts = lambda jobs, **k: [(o["job_id"], o["action"]) for o in run(folds.moving(folds.enforce, **k), jobs)]
    bad = [job(i, True) for i in range(1, 5)]
    assert acts(bad, limit=2, window=3, disable_limit=9) == [(2, "warning"), (2, "escalation")]
    again = [*bad, *[job(i, False) for i in range(5, 8)], job(8, True), job(9, True)]
    assert acts(again, limit=2, window=3, disable_limit=9) == [(2, "warning"), (2, "escalation"), (9, "warning")]
    assert acts([job(i, True, mode="blocking") for i in range(3)], limit=2, disable_limit=9) == [(1, "warning")]
    assert acts([job(1, True, disposition="immediate_disable")], limit=9) == [(1, "disable")]
    assert acts([job(i, True, disposition="notice_only") for i in range(9)], limit=99, disable_limit=2) == []
    assert acts([job(i, True, role="admin") for i in range(9)], limit=99, disable_limit=2) == []
    assert acts([job(i, True) for i in range(1, 4)], limit=99, disable_limit=3) == [(3, "disable")]


def test_breakers():
    m = lambda u, event="": {"hash_key": "h", "user_id": u, "job_id": u, "event": event}
    assert [o["outcome"] for o in run(folds.break_circuit, [m(1), m(1), m(2), m(3), m(1)])] == ["countable", "repeated", "suppressed", "suppressed", "repeated"]
    assert [o["outcome"] for o in run(folds.break_circuit, [m(0, "confirm"), m(1), m(2), m(3)])] == ["countable"] * 3
    assert [o["outcome"] for o in run(folds.break_circuit, [m(0, "trust"), m(1)])] == ["suppressed"]


def test_notices():
    n = lambda i, at: {"user_id": 1, "id": i, "at_s": at}
    got = run(folds.throttle, [n(1, 0), n(2, 10), n(3, 3599), n(4, 3600), n(5, 3700)])
    assert [(o["sent"], o["held_back"]) for o in got] == [(True, 0), (False, 1), (False, 2), (True, 2), (False, 1)]


def test_node_health():
    c = lambda at, error="", retryable=True, after=0, ms=100: {"model_id": 1, "at_s": at, "latency_ms": ms, "error": error, "retryable": retryable, "retry_after_s": after}
    got = run(folds.node_health, [c(0), c(1, "timeout"), c(2, "timeout"), c(20, "timeout"), c(60, "rate_limited", after=90), c(200), c(201, "invalid_model"), c(202, "upstream_http_error", False)])
    assert [(o["health"], o["cooldown_until"]) for o in got] == [("healthy", None), ("degraded", None), ("cooldown", 17), ("cooldown", 50), ("cooldown", 150), ("healthy", None), ("misconfigured", None), ("misconfigured", None)]
    assert run(folds.node_health, [c(0, ms=100), c(1, ms=200)])[-1]["latency_ewma"] == pytest.approx(120)


def test_reset_detector():
    w = folds.WEEK_S
    s = lambda now, reset, used=1.0, epoch="e", up="a", off=0: {"epoch": epoch, "now_s": now, "fetched_s": now - off, "reset_s": reset, "used": used, "upstream": up}
    rules = lambda *x: [o["rule"] for o in run(folds.detect_reset, x)]
    assert rules(s(100, 100 + w), s(200, 105 + w)) == ["first", "same"]
    natural = run(folds.detect_reset, [s(100, 100 + w), s(150 + w, 140 + 2 * w)])
    assert (natural[1]["rule"], natural[1]["event_key"], natural[1]["reset_at_s"]) == ("natural", f"automatic:e:{100 + w}", 140 + w)
    assert run(folds.detect_reset, [s(100, 100 + w), s(200, 300 + 2 * w)])[1]["event_key"] == f"automatic:e:{100 + w}"
    assert rules(s(100, 100 + w), s(200, 300 + 2 * w)) == ["first", "early"]
    assert rules(s(100, 100 + w, used=0), s(200, 300 + 2 * w)) == ["first", "drift"]
    assert rules(s(100, 100 + 3 * w), s(200, 300 + w)) == ["first", "back"]
    assert rules(s(100, 100 + w), s(200 + w, 100 + w)) == ["first", "not_switched"]
    assert rules(s(100, 100 + w), s(200 + w, 0, used=0), s(300 + w, 0, used=0), s(400 + w, 400 + 2 * w)) == ["first", "ended", "no_reset_time", "awaited"]
    assert rules(s(100, 100 + w), s(200, 200 + 3 * w, up="b"), s(300, 300 + w, epoch="f")) == ["first", "first", "first"]
    assert rules(s(100, 100 + w), s(100, 100 + w), s(500, 500 + w, off=61), s(600, 600 + w, used=-1)) == ["first", "refused", "refused", "refused"]
    assert rules(s(100, 0)) == ["no_reset_time"]


def test_token_bucket():
    r = lambda i, at: {"connection": 1, "id": i, "at_s": at}
    got = run(folds.token_bucket, [*[r(i, 0.0) for i in range(42)], r(50, 0.1), r(51, 0.1), r(52, 0.1)])
    assert [o["allowed"] for o in got] == [True] * 40 + [False] * 2 + [True, True, False]


# --- streams -------------------------------------------------------------------------------------------------------------


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    marks = spark.createDataFrame([(h, u, 10 * h + u, "") for h in range(3) for u in (1, 2, 3)], "hash_key long, user_id long, job_id long, event string")
    schema = "hash_key long, user_id long, job_id long, outcome string, status string, users long"
    for i in (1, 2, 3):
        marks.where(f"user_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = streams.event_stream(spark, str(tmp_path / "in"), marks.schema)
    got = streams.run_to_table(folds.run_stream(live, "hash_key", ["job_id"], folds.break_circuit, schema), "marks_out", str(tmp_path / "c"))
    want = folds.run_batch(marks, "hash_key", ["job_id"], folds.break_circuit, schema)
    assert sorted(map(tuple, got.select("hash_key", "job_id", "outcome").collect())) == sorted(map(tuple, want.select("hash_key", "job_id", "outcome").collect()))


def test_hourly_stream(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = streams.event_stream(spark, str(tmp_path / "in"), events.schema)
    got = {r["hour"]: r["jobs"] for r in streams.run_to_table(streams.hourly_counts(live), "hours_out", str(tmp_path / "c"), "update").collect()}
    want = {r["hour"]: r["n"] for r in events.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("hour")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_diff_keeps_a_longest_common_subsequence():
    import random

    rng = random.Random(3)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        steps = diff.common_lines(x, y)
        assert sum(s[0] == "equal" for s in steps) == best[0][0]
        assert [v for s in steps if s[0] != "insert" for v in x[s[1] : s[2]]] == x and [v for s in steps if s[0] != "delete" for v in y[s[3] : s[4]]] == y
        assert all(x[s[1]] == y[s[3]] for s in steps if s[0] == "equal")
