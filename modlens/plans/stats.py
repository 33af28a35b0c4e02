"""Overview statistics: counts, waits, durations, cache misses, churn, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions.decisions import reason_codes
from modlens.operators.filters import all_of, between
from modlens.operators.quantiles import exact_percentiles
from modlens.sources.tables import Tables

SINCE, UNTIL = "1995-01-01", "1997-01-01"


def in_range(df: DataFrame, column: str = "created_at", since: str = SINCE, until: str = UNTIL) -> DataFrame:
    return all_of(df, between(column, since, until))


def millis(later: str, earlier: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(later)) / 1000


def exact(column: str | Column, p: float) -> Column:
    """An exact, interpolating percentile of a small group: it holds the group's distinct values."""
    return F.percentile(column, p)


def headline(t: Tables, mode: str | None = None) -> DataFrame:
    jobs = in_range(t.jobs)
    jobs = jobs.where(F.col("run_mode") == mode) if mode else jobs
    n = lambda c: F.count_if(c)
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"), n(F.col("orphan_continuation")).alias("orphans"), n(F.col("run_kind") == "reaudit").alias("reaudits"), n(F.col("status") == "failed").alias("failed"),
        *[n(F.col("decision") == d).alias(d) for d in ("pass", "review", "block")],
    )


def backlog(t: Tables) -> DataFrame:
    return t.jobs.where(F.col("status").isin("queued", "retry")).agg(F.count(F.lit(1)).alias("waiting"), F.min("created_at").alias("since"))


def action_stock(t: Tables) -> DataFrame:
    """Open actions by state, with the total beside each."""
    open_ = F.col("execution_status").isin("pending", "processing", "unknown") | F.col("notification_status").isin("pending", "processing", "retry")
    by = t.actions.where(open_).groupBy("execution_status").agg(F.count(F.lit(1)).alias("n"))
    return by.join(by.agg(F.sum("n").alias("total")), how="inner")


def blocking_waits(t: Tables) -> DataFrame:
    w = in_range(t.jobs).where("run_mode = 'blocking' AND blocking_wait_ms IS NOT NULL")
    got = exact_percentiles(w, {"ms": F.col("blocking_wait_ms")}, (0.5, 0.95))["ms"]
    most = None if got["most"] is None else int(got["most"])
    return t.spark.createDataFrame([(got["n"], got["mean"], most, got[0.5], got[0.95])], "n long, mean double, most long, p50 double, p95 double")


def durations(t: Tables) -> DataFrame:
    """Whole, queueing and processing times of the range's jobs; a percentile skips what has no times."""
    spans = {"whole": ("finished_at", "created_at"), "queue": ("started_at", "created_at"), "work": ("finished_at", "started_at")}
    points = (0.5, 0.95)
    got = exact_percentiles(in_range(t.jobs), {k: millis(*v) for k, v in spans.items()}, points)
    names = [f"{k}_p{int(p * 100)} double" for k in spans for p in points]
    return t.spark.createDataFrame([tuple(got[k][p] for k in spans for p in points)], ", ".join(names))


def cache_misses(t: Tables) -> DataFrame:
    jobs = in_range(t.jobs).select("id", "client_fingerprint")
    by = t.targets.join(jobs, F.col("job_id") == F.col("id")).groupBy("client_fingerprint", "kind").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("resolution") == "model").alias("calls"))
    return by.withColumn("miss_rate", F.col("calls") / F.col("targets"))


def template_churn(t: Tables, as_of: str = "1997-01-01", days: int = 7) -> DataFrame:
    """Distinct instruction texts for each distinct job of the last days, by client; 0 without jobs."""
    jobs = t.jobs.where((F.col("created_at") >= F.expr(f"timestamp_ntz '{as_of}' - interval {days} days")) & (F.col("created_at") < F.expr(f"timestamp_ntz '{as_of}'"))).select("id", "client_fingerprint")
    by = t.targets.where("kind = 'instruction'").join(jobs, F.col("job_id") == F.col("id")).groupBy("client_fingerprint").agg(F.countDistinct("hash_key").alias("hashes"), F.countDistinct("job_id").alias("jobs"))
    return by.withColumn("churn", F.when(F.col("jobs") > 0, F.col("hashes") / F.col("jobs")).otherwise(0.0))


def category_counts(t: Tables) -> DataFrame:
    """Blocked jobs by category; a job without any counts under the empty one."""
    blocked = in_range(t.jobs).where("decision = 'block'").select(F.explode_outer("trigger_categories").alias("c"))
    return blocked.groupBy(F.coalesce("c", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def node_results(t: Tables) -> DataFrame:
    """Scoring results as (job, node, confidence, reason): each call's reason names a category or doesn't."""
    reason = F.when(F.col("line") % 3 == 0, F.concat(F.lit("违规/R0"), (1 + F.col("model_id") % 9).cast("string"), F.lit("：x"))).when(F.col("line") % 3 == 1, F.concat(F.lit("待复核/R01、R0"), (1 + F.col("hash_key") % 9).cast("string"), F.lit(": y"))).otherwise(F.lit("ok"))
    return t.attempts.where("call_kind = 'audit'").select("job_id", "model_id", "confidence", "status", reason.alias("reason"))


def recognition(t: Tables) -> DataFrame:
    """How often a node's reason names a category, of its valid results on blocked and reviewed jobs."""
    jobs = in_range(t.jobs).where("decision IN ('block', 'review')").select("id")
    valid = node_results(t).where("status = 'succeeded' AND confidence IS NOT NULL").join(jobs, F.col("job_id") == F.col("id"))
    by = valid.groupBy("model_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(reason_codes(F.col("reason")).isNotNull()).alias("recognised"))
    return by.withColumn("rate", F.col("recognised") / F.col("total"))


def by_status(t: Tables) -> DataFrame:
    return t.jobs.groupBy("status", F.coalesce("decision", F.lit("")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def hourly(t: Tables) -> DataFrame:
    """Jobs by the day's hour in which their users' actions fell: counts and mean wait."""
    a = t.actions.groupBy(F.date_trunc("hour", "requested_at").alias("hour"))
    return a.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("execution_status") == "failed").alias("failed"), F.count_if(F.col("notification_status") == "failed").alias("unsent"), F.round(F.avg("value"), 6).alias("mean_value"))


def failure_alert(t: Tables, rate: float = 0.2, least: int = 20) -> DataFrame:
    """Hours of many failures: `least` actions or more, `rate` of them or more failed."""
    by = t.actions.groupBy(F.date_trunc("hour", "requested_at").alias("hour")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("execution_status") == "failed").alias("failed"))
    by = by.withColumn("rate", F.col("failed") / F.col("jobs"))
    return by.withColumn("alert", (F.col("jobs") >= least) & (F.col("rate") >= rate))
