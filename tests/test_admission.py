"""Admission in batch, in a stream and by hand; folds over sorted partitions against plain loops."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from modlens.plans import registry
from modlens.sources.tables import Tables
from modlens.streaming import admission, folds, streams

SF = "/root/testdata/sf0.001"
MINUTE = 60_000_000


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def log_of(spark, *rows):
    """Rows (minute, tag, id, turn, previous, mode, status, decision); previous False is no continuation."""
    made = [(1, int(m * MINUTE), tag, i, turn, prev is not False, prev or None, mode, status, decision) for m, tag, i, turn, prev, mode, status, decision in rows]
    return spark.createDataFrame(made, admission.LOG)


def ask(m, i, turn="a", prev=False, mode="async"):
    return (m, admission.REQUEST, i, turn, prev, mode, None, None)


def says(m, i, decision, turn="a", status="done"):
    return (m, admission.VERDICT, i, turn, False, None, status, decision)


def replies(m, i, turn="a"):
    return (m, admission.REPLY, i, turn, False, None, None, None)


CASES = [
    # a turn is bound while it is used at least every half hour, and starts anew after that
    ([ask(0, 1), ask(29, 2), ask(58, 3), ask(88, 4)], ["new 1", "allow 1", "allow 1", "new 4"]),
    # what a known turn gives
    ([ask(0, 1), ask(1, 2, mode="blocking"), says(2, 1, "review"), ask(3, 3), says(4, 1, "block"), ask(5, 4), says(6, 1, "pass"), ask(7, 5, mode="blocking")], ["new 1", "wait 1", "flag 1", "block 1", "allow 1"]),
    ([ask(0, 1), says(1, 1, "", status="failed"), ask(2, 2), ask(3, 3, mode="blocking")], ["new 1", "allow 1", "wait 1"]),
    # a verdict of a request that started no job says nothing, and a late one enters its turn again
    ([ask(0, 1), ask(1, 2), says(2, 2, "block"), ask(3, 3)], ["new 1", "allow 1", "allow 1"]),
    ([ask(0, 1), says(29, 1, "block"), ask(58, 2)], ["new 1", "block 1"]),
    # continuations: by the reply they name, by their own turn, or as first requests
    ([ask(0, 1), says(1, 1, "block"), replies(2, 1), ask(3, 2, "b", "r1"), ask(4, 3, "b")], ["new 1", "block 1", "new 3"]),
    ([ask(0, 1), says(1, 1, "block"), ask(2, 2, "a", ""), ask(3, 3, "b", "r9"), ask(4, 4, "b", "")], ["new 1", "block 1", "new 3", "allow 3"]),
    # a reply is known while it is asked for, but its turn must live too
    ([ask(0, 1), replies(1, 1), ask(20, 2, "b", "r1"), ask(45, 3, "b", "r1"), ask(70, 4, "b", "r1")], ["new 1", "allow 1", "allow 1", "allow 1"]),
    ([ask(0, 1), replies(1, 1), ask(32, 2, "b", "r1")], ["new 1", "new 2"]),
    # a reply stands for its request's own turn, not for the one that was bound
    ([ask(0, 1), replies(1, 1), ask(2, 2, "b", "r1"), replies(3, 2, "b"), ask(4, 3, "c", "r2")], ["new 1", "allow 1", "new 3"]),
]


@pytest.mark.parametrize(("log", "want"), CASES)
def test_by_hand(spark, log, want):
    got = admission.admitted(log_of(spark, *log)).collect()
    assert [f"{r['kind']} {r['job_id']}" for r in sorted(got, key=lambda r: r["id"])] == want
    assert all((r["error"] == "third_party_audit_blocked") == (r["kind"] == "block") for r in got)


def test_state_ends_by_itself():
    table = admission.Table(10)
    for i in range(10_000):
        table.find("x", i)
        table.put(str(i), (i,))
    assert len(table.held) <= 11 and table.find("9999", 9_999) == (9_999,) and table.find("9989", 9_999) is None


def test_odd_logs(spark):
    log = log_of(spark, *CASES[1][0]).selectExpr("*", "'x' AS kind", "1 AS job_id")
    none = log.limit(1).selectExpr("user_id", "at", "tag", "CAST(NULL AS long) AS id", "turn", "continuation", "previous", "mode", "status", "decision", "kind", "job_id")
    assert rows_of(admission.admitted(log.unionByName(none))) == rows_of(admission.admitted(log))
    assert admission.admitted(log.limit(0)).count() == 0
    twice = log.selectExpr("CAST(NULL AS long) AS user_id", "at", "tag", "id", "turn", "continuation", "previous", "mode", "status", "decision")
    assert [r["kind"] for r in admission.admitted(twice).orderBy("id").collect()] == [r["kind"] for r in admission.admitted(log).orderBy("id").collect()]


def test_stream_equals_batch(spark, tmp_path):
    log = admission.event_log(registry._with_back(Tables(spark, SF)))
    ttl = 12 * 60 * MINUTE
    rows = log.orderBy("at", "tag", "id").collect()
    for i in range(4):  # four files, one after the other in time
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        spark.createDataFrame(part, admission.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # an availableNow query of timed states would go on making batches without data
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        live = streams.event_stream(spark, str(tmp_path / "in"), log.schema)
        got = rows_of(streams.run_to_table(admission.admitted_stream(live, ttl), "admitted_out", str(tmp_path / "c")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = rows_of(admission.admitted(log, ttl))
    assert got == want and len(want) == 1000
    kinds = Counter(r[2] for r in want)
    assert min(kinds[k] for k in ("new", "allow", "flag", "block", "wait")) > 0
    assert Path(tmp_path / "c").exists()


def plain(rows, key, order, fold, schema):
    """The fold over sorted rows, a loop."""
    names, out, state, now = [c.split()[0] for c in schema.split(", ")], [], {}, object()
    for r in sorted((r.asDict() for r in rows), key=lambda r: [(r[c] is not None, r[c] or 0) for c in (key, *order)]):
        if r[key] != now:
            state, now = {}, r[key]
        state, made = fold(state, r)
        out += [tuple(m[n] for n in names) for m in made]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["g2_admission", "g6_enforcement", "g9_throttled_notices", "g13_node_health", "g17_reset_detector", "g35_enable_and_reset"])
def test_queries_equal_plain_loops(spark, monkeypatch, name):
    seen = []
    real = folds.run_batch
    monkeypatch.setattr(folds, "run_batch", lambda *a: seen.append(a) or real(*a))
    got = registry.QUERIES[name](spark, SF)
    df, *how = seen[0]
    assert rows_of(got) == [tuple(float(v) if isinstance(v, int) and k == "double" else v for v, (_, k) in zip(r, got.dtypes, strict=True)) for r in plain(df.collect(), *how)]


def test_batches_of_a_hot_key(spark):
    """One key has nearly all rows, in many Arrow batches; the state goes from each to the next."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("user_id"), "id", (F.col("id") * 100).alias("at_s"))
        got = folds.run_batch(rows, "user_id", ["at_s", "id"], folds.throttle, "user_id long, id long, sent boolean, held_back long")
        assert got.where("user_id = 1 AND sent").count() == -(-2900 // 36) and got.count() == 3000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def history(*rows):
    """Outputs of enforce_all for rows (tag, at, id, ok), jobs with one violation each."""
    state, out = {}, []
    for tag, at, i, ok in rows:
        job = tag in (folds.JOB, folds.REAUDIT)
        r = {"tag": tag, "at": at, "id": i, "ok": ok, "user_id": 1, "eligible": True, "violation": ok if tag == folds.JOB else True, "run_mode": "blocking", "role": "user", "user_status": "active", "disposition": "", "created": at if tag == folds.JOB else i if job else None}
        state, made = folds.enforce_all(state, r, limit=9, window=3, disable_limit=2)
        out += [f"{m['action']} {m['counted']}" for m in made]
    return out


def test_resets():
    job, again, reset, sent, done = (folds.JOB, folds.REAUDIT, folds.RESET, folds.SENT, folds.RESET_DONE)
    bad = [(job, 1, 1, True), (job, 2, 2, True)]
    assert history(*bad, (job, 3, 3, True)) == ["disable 2"]
    assert history(*bad, (reset, 3, 9, True), (sent, 4, 9, True), (done, 5, 9, True)) == ["disable 2", "cancelled 2", "reset 2", "enabled 0"]
    assert history(*bad, (sent, 3, 9, False), (reset, 4, 9, True), (sent, 5, 9, True), (reset, 6, 9, True), (reset, 7, 9, True), (done, 8, 9, True)) == ["disable 2", "unknown 2", "refused 2", "disabled 2", "reset 2", "refused 2", "enabled 0"]
    # a cleared job takes its count back once, unless a reset came after it
    assert history(*bad[:1], (again, 2, 1, True), (job, 3, 3, True), (job, 4, 4, True)) == ["uncounted 0", "disable 2"]
    assert history(*bad[:1], (reset, 2, 9, True), (done, 3, 9, True), (again, 4, 1, True), (job, 5, 5, True), (job, 6, 6, True)) == ["reset 1", "enabled 0", "disable 2"]
    assert history((again, 1, 1, False), (sent, 2, 9, True), (done, 3, 9, True)) == []
