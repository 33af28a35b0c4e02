"""Console views: refused parameters, the byte order mark, hashes as JSON makes them, and valid subscriptions one predicate at a time."""

from __future__ import annotations

import csv
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from modlens.operators.filters import JobFilter
from modlens.plans import console
from modlens.sources import sinks
from modlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("limit", "offset"), [(0, 0), (5001, 0), (10, -1)])
def test_export_refuses(spark, limit, offset):
    with pytest.raises(ValueError, match="limit"):
        console.export_page(Tables(spark, SF), JobFilter(), limit, offset)


def test_export_pages_follow_each_other(spark):
    t = Tables(spark, SF)
    wanted = JobFilter(decision="block")
    whole = console.export_page(t, wanted, 60, 0).collect()
    parts = [r for k in range(3) for r in console.export_page(t, wanted, 20, 20 * k).collect()]
    key = lambda r: (-int(r["job_id"]), r["target_order"], r["text"], r["resolution"])
    assert sorted(map(key, whole)) == sorted(map(key, parts)) and whole[0].asDict().keys() == {*console.EXPORT, "has_more"}
    assert all(r["has_more"] for r in whole) and not any(r["has_more"] for r in console.export_page(t, wanted, 5000, 10).collect())


def test_csv_begins_with_a_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, '=a"b, c', 0.5)], "id int, text string, score double").coalesce(1), str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,text,score")
    assert list(csv.reader(raw.decode("utf-8-sig").splitlines())) == [["id", "text", "score"], ["1", "'=a\"b, c", "0.5000"]]


def test_hashes_of_configurations(spark):
    t = Tables(spark, SF)
    nodes = [{"ID": str(r["model_id"]), "BaseURL": r["base_url"], "Model": r["model"], "APIFormat": r["api_format"], "TimeoutMS": str(r["timeout_ms"])} for r in t.node_configs.where("enabled").orderBy("model_id").collect()]
    got = {r["draft"]: r for r in console.config_impact(t, console.DRAFTS).collect()}
    for draft, kind in (("same", "user"), ("policy", "instruction")):
        form = {"Policy": console.DRAFTS[draft][0], "Contract": "contract", "Version": "3", "Kind": kind, "Nodes": nodes}
        assert got[draft][f"{kind}_hash"] == hashlib.sha256(json.dumps(form, separators=(",", ":")).encode()).hexdigest()
    assert {d: (r["parts"], r["user_changed"]) for d, r in got.items()} == {"same": ("", False), "policy": ("policy", True), "timeouts": ("nodes", True), "off": ("nodes", True), "idle": ("", False)}


def test_each_predicate_counts(spark):
    t = Tables(spark, SF)
    valid = console.valid_subscriptions(t).select("id", "user_id", "group_id").collect()
    assert valid
    i, user, group = valid[0]
    for table, name, spoil in (
        ("subscriptions", i, {"deleted": F.lit(True)}), ("subscriptions", i, {"status": F.lit("suspended")}), ("subscriptions", i, {"starts_at": F.lit("1996-01-01").cast("timestamp_ntz")}),
        ("users", user, {"deleted": F.lit(True)}), ("users", user, {"status": F.lit("disabled")}), ("users", user, {"role": F.lit("admin")}),
        ("quota_groups", group, {"deleted": F.lit(True)}), ("quota_groups", group, {"status": F.lit("disabled")}), ("quota_groups", group, {"platform": F.lit("gemini")}), ("quota_groups", group, {"subscription_type": F.lit("balance")}),
    ):
        other = Tables(spark, SF)
        rows = getattr(t, table)
        other.__dict__[table] = rows.withColumns({c: F.when(F.col("id") == name, v).otherwise(F.col(c)) for c, v in spoil.items()})
        left = {r["id"] for r in console.valid_subscriptions(other).collect()}
        assert i not in left and left < {r["id"] for r in valid}


def test_filters_of_the_job_list(spark):
    jobs = console.placed_jobs(Tables(spark, SF))
    one = jobs.where("platform IS NOT NULL").first()
    for field in ("api_key_id", "group_id", "platform", "request_id", "model"):
        got = JobFilter(**{field: one[field]}).apply(jobs)
        assert 0 < got.count() == jobs.where(F.col(field) == one[field]).count() < jobs.count()
