"""Reports over tables made for what the given ones lack."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from modlens.operators import similar
from modlens.plans import lifecycle, registry
from modlens.sources.tables import Tables
from modlens.streaming import folds


def test_replay_asks_every_enabled_node(spark, tmp_path):
    low, high = [n for n in range(1, 300) if n * 17 % 100 < 30][:64], [n for n in range(300, 700) if n * 17 % 100 >= 60][:100]
    suppliers = [(n, f"s{n}", 1.0) for n in low + high] + [(n, "off", -1.0) for n in range(800, 1100)]
    labels = [(i, 1, i % 2) for i in range(40)] + [(3, 1, 1)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = set()
    for i, _, toxic in labels:
        x = [(i * 31 + n * 17) % 100 for n in low + high]
        b, r = sum(v >= 60 for v in x), sum(30 <= v < 60 for v in x)
        want.add((i, "block" if toxic else "pass", "block" if b >= len(x) // 2 + 1 else "review" if b + r else "pass"))
    got = [tuple(r) for r in registry.QUERIES["g28_policy_replay"](spark, str(tmp_path)).select("id", "expected", "decision").collect()]
    assert len(got) == len(want) and set(got) == want and (0, "pass", "block") in want


def test_notices_between_whole_seconds(spark, tmp_path):
    """Gaps of nearly an hour, from and to any part of a second: as the SQL has them."""
    import duckdb

    start, hour = datetime(2024, 1, 1), 3_600_000_000
    parts = [0, 1, 499_999, 500_000, 500_001, 999_999, 1_500_000]
    at = [(i * 7 + j, i * 7 + j, a, hour + b) for i, a in enumerate(parts) for j, b in enumerate(parts)]
    events = [(2 * i + k, start + timedelta(microseconds=us), u, "error", 1.0, "{}") for i, u, *both in at for k, us in enumerate(both)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in registry.QUERIES["g9_throttled_notices"](spark, str(tmp_path)).select("user_id", "id", "sent", "held_back").collect())
    db = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(db.execute(registry.ORACLES["g9_throttled_notices"]).fetchall()) and {r[2] for r in got if r[1] % 2} == {True, False}


def test_replay_by_classes(spark, tmp_path):
    """A hundred samples' and nodes' classes at the most, whatever their number; ids below zero, remainders of which are negative, and null."""
    suppliers = [(n, f"s{n}", 1.0) for n in [*range(-40, 700), None]] + [(n, "off", -1.0) for n in range(800, 900)]
    labels = [(i, 1, i % 2) for i in [*range(-900, 40), *range(2000, 2020)]] + [(3, 1, 1), (None, 1, 0)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = set()
    for i, _, toxic in labels:
        x = [int(math.fmod(i * 31 + n * 17, 100)) if i is not None and n is not None else -1 for n, _, on in suppliers if on >= 0]
        b, r = sum(v >= 60 for v in x), sum(30 <= v < 60 for v in x)
        want.add((i, "block" if toxic else "pass", "block" if b >= len(x) // 2 + 1 else "review" if b + r else "pass"))
    got = [tuple(r) for r in registry.QUERIES["g28_policy_replay"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and {w[2] for w in want} == {"review", "pass"}
    ids = Tables(spark, str(tmp_path)).samples
    assert lifecycle.vote_classes(ids.where("id >= 0"), "id", 31, 0).select("folded", "rest").distinct().count() == 40
    assert lifecycle.vote_classes(spark.range(20_000), "id", 17, 0).select("folded", "rest").distinct().count() == 100


def test_similar_pairs_are_dealt_out(spark):
    """Twenty rows a hash are never broadcast, and no task gathers pairs to tell them apart; members are hashed, not sorted with the pairs."""
    df = spark.range(500).select("id", (F.col("id") * 3).alias("simhash"))
    got = similar.similar_pairs(df, df)
    plan = got._jdf.queryExecution()
    physical, logical = plan.sparkPlan().toString(), plan.optimizedPlan().toString()
    assert "Broadcast" not in physical and physical.count("ShuffledHashJoin") == 2 and physical.count("SortMergeJoin") == 1
    assert not [line for line in logical.split("\n") if "Aggregate" in line and "ha#" in line and "hb#" in line]
    pairs = [(r["a"], r["b"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(b, a) for a, b in pairs} and pairs


def test_kept_texts_sort_no_targets(spark):
    """Targets stream past hashed jobs, and no review is ranked for its text; on ties and old reviews as the SQL has it."""
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = lifecycle.kept_texts(t)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and plan.count("ShuffledHashJoin") >= 3
    kept = lifecycle.kept_reviews(t)
    texts = {r[0] for r in t.texts.select("hash_key").collect()}
    refs = [lifecycle.kept_targets(t), kept, t.trust, t.breakers]
    want = {r[0] for df in refs for r in df.select("hash_key").distinct().collect()} & texts
    assert {r["hash_key"] for r in lifecycle.kept_texts(t).collect()} == want


def test_folds_are_dealt_into_the_sessions_tasks(spark):
    """As many tasks as the session shuffles into, which aren't joined to fewer, so a task sorts its share alone."""
    rows = spark.range(100).select((F.col("id") % 9).alias("user_id"), "id", (F.col("id") * 100).alias("at_s"))
    got = folds.run_batch(rows, "user_id", ["at_s", "id"], folds.throttle, "user_id long, id long, sent boolean, held_back long")
    admitted = registry.QUERIES["g2_admission"](spark, "/root/testdata/sf0.001")
    for df in (got, admitted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan and "ENSURE_REQUIREMENTS" not in plan
    assert got.count() == 100
