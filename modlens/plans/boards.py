"""Boards of users, costs, work and similar texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlens.functions.text import content_hash, csv_guard, normalise, simhash64
from modlens.operators.filters import JobFilter, action_filter, all_of, keyword_or_id, text_search
from modlens.operators.relational import flag, latest_per, max_per, page
from modlens.functions import diff
from modlens.operators.similar import nearest_before, similar_pairs
from modlens.plans.stats import exact, in_range
from modlens.sources.tables import Tables

RISK_ORDER = {
    "blocks": lambda: [F.desc("blocks"), F.asc("user_id")],
    "violations": lambda: [F.desc("violations"), F.asc("user_id")],
    "last_block_at": lambda: [F.desc_nulls_last("last_block_at"), F.asc("user_id")],
}


def risk_users(t: Tables, sort: str = "blocks", keyword: str = "", number: int = 1, size: int = 20) -> DataFrame:
    """Users of the range by risk: jobs are summed up by user first, then the names are joined. Deleted users stay, without names."""
    blocked = F.col("decision") == "block"
    agg = in_range(t.jobs).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(blocked).alias("blocks"), F.count_if(F.col("decision") == "review").alias("reviews"), F.count_if("violation_counted").alias("violations"), F.max(F.when(blocked, F.col("created_at"))).alias("last_block_at"),
    )
    users = t.users.where("NOT deleted").selectExpr("id", "username", "email", "role", "status AS user_status")
    pending = t.actions.where("execution_status IN ('pending', 'processing', 'unknown')").groupBy(F.col("user_id").alias("pu")).agg(F.count(F.lit(1)).alias("pending"))
    last = max_per(t.jobs.where(blocked & F.col("trigger_categories").isNotNull()).withColumnRenamed("user_id", "cu"), ["cu"], "trigger_categories", "id", "categories")
    out = agg.join(users, F.col("user_id") == F.col("id"), "left").join(pending, F.col("user_id") == F.col("pu"), "left").join(last, F.col("user_id") == F.col("cu"), "left")
    out = all_of(out, keyword_or_id(keyword, ("username", "email"), ("user_id",)))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    out = out.select("user_id", *[text(c) for c in ("username", "email", "role", "user_status")], "jobs", "blocks", "reviews", "violations", "last_block_at", F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), F.coalesce(F.array_join("categories", ","), F.lit("")).alias("categories"))
    return page(out, RISK_ORDER.get(sort, RISK_ORDER["blocks"])(), number, size)


def costs(t: Tables, bucket: str = "month", zone: str = "Asia/Shanghai") -> DataFrame:
    """Calls and tokens by bucket of local time, node, kind and stage. A node's own name counts, then that of the call."""
    a = in_range(t.attempts, "dispatch_started_at")
    local = F.date_trunc(bucket, F.from_utc_timestamp(F.col("dispatch_started_at").cast("timestamp"), zone)).cast("timestamp_ntz")
    done = F.col("status") == "succeeded"
    by = a.groupBy(local.alias("bucket"), "model_id", "call_kind", "stage").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(done).alias("succeeded"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(done & (F.col("input_tokens").isNull() | F.col("output_tokens").isNull())).alias("unknown_usage"), exact("latency_ms", 0.5).alias("p50_ms"),
    )
    nodes = t.nodes.select(F.col("model_id").alias("nid"), "name")
    return by.join(nodes, F.col("model_id") == F.col("nid"), "left").select(*by.columns, F.coalesce(F.nullif("name", F.lit("")), F.lit("snapshot")).alias("node"))


def reuse(t: Tables) -> DataFrame:
    jobs = in_range(t.jobs).select("id")
    return t.targets.where("resolution IS NOT NULL").join(jobs, F.col("job_id") == F.col("id")).groupBy("kind", "resolution").agg(F.count(F.lit(1)).alias("targets"))


def cost_summary(t: Tables) -> DataFrame:
    """The cost board by node: audit, repair and probe calls apart, all tokens, and the node's share of them."""
    kind = F.when(F.col("call_kind") != "audit", "probe").when(F.col("stage") == "format_repair", "repair").otherwise("audit")
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    by = in_range(t.attempts, "dispatch_started_at").withColumn("k", kind).groupBy("model_id").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("audit", "repair", "probe")], F.sum(tokens).alias("tokens"))
    total = by.agg(F.sum("tokens").alias("all_tokens"))
    return by.join(total, how="inner").select("model_id", "audit", "repair", "probe", "tokens", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("share"))


def inbox(t: Tables, as_of: str = "2024-01-20", days: int = 7) -> DataFrame:
    """What waits for an operator: a row of each category with its count, and their total."""
    recent = F.col("requested_at") >= F.expr(f"timestamp_ntz '{as_of}' - interval {days} days")
    a = t.actions.where("execution_status IN ('failed', 'unknown') OR notification_status = 'failed'").agg(F.count_if(F.col("execution_status").isin("failed", "unknown")).alias("action_failed"), F.count_if((F.col("notification_status") == "failed") & recent).alias("notification_failed"))
    rows = a.select(F.explode(F.create_map(F.lit("action_failed"), "action_failed", F.lit("notification_failed"), "notification_failed")).alias("category", "n"))
    rows = rows.union(t.breakers.where("status = 'tripped'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("breaker_pending"), "n"))
    return rows.union(rows.agg(F.sum("n")).select(F.lit("total"), "sum(n)"))


def recent_failures(t: Tables, n: int = 5) -> DataFrame:
    return t.actions.where("execution_status IN ('failed', 'unknown')").orderBy(F.desc("id")).limit(n).select("id", "user_id", "execution_status", "requested_at", F.get_json_object("business_snapshot", "$.k").alias("k"))


def action_list(t: Tables) -> DataFrame:
    found = action_filter(t.actions, execution=("failed", "unknown"), since="2024-01-05", until="2024-01-20")
    return page(found.select("id", "user_id", "execution_status", "notification_status", "requested_at", F.get_json_object("business_snapshot", "$.k").alias("k")), [F.desc("id")], 1, 50)


def job_list(t: Tables) -> DataFrame:
    """A page of filtered jobs with the user's name, the wait in ms and whether an action is open."""
    jobs = JobFilter(mode="blocking", status="done", since="1995-01-01", until="1996-01-01").apply(t.jobs)
    users = t.users.where("NOT deleted").select(F.col("id").alias("uid"), F.nullif("username", F.lit("")).alias("name"))
    out = jobs.join(users, F.col("user_id") == F.col("uid"), "left")
    out = flag(out, t.actions.where("execution_status IN ('pending', 'unknown')"), "user_id", "action_pending")
    work = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) / 1000, F.lit(0)).cast("long")
    return page(out.select("id", "user_id", F.coalesce("name", F.lit("")).alias("username"), "decision", work.alias("work_ms"), "action_pending", "created_at"), [F.desc("created_at"), F.desc("id")], 2, 100).drop("created_at")


def category_jobs(t: Tables) -> DataFrame:
    return JobFilter(category="R02", decision="block").apply(t.jobs).select("id", "user_id", F.array_join("trigger_categories", ",").alias("categories"))


def job_prompts(t: Tables) -> DataFrame:
    """Targets of the jobs' present round with their texts and whether the hash is trusted, in no order."""
    jobs = t.jobs.where("status = 'done'").select("id", "current_round")
    cur = t.targets.join(jobs, (F.col("job_id") == F.col("id")) & (F.col("round") == F.col("current_round")))
    texts = t.texts.select(F.col("hash_key").alias("h"), "text")
    out = flag(cur.join(texts, F.col("hash_key") == F.col("h"), "left"), t.trust, "hash_key", "trusted")
    return out.select("job_id", "target_order", "kind", "hash_key", "resolution", F.coalesce(F.left("text", F.lit(10)), F.lit("")).alias("preview"), "trusted")


def export(t: Tables, most: int = 1000) -> DataFrame:
    """Jobs with their present targets, texts and scores, as an export writes them."""
    jobs = t.jobs.where("decision = 'block'").select("id", "created_at", "user_id", "run_mode", "status", "decision", "current_round")
    tg = t.targets.select("job_id", "target_order", "kind", "hash_key", "resolution", "review_id", "round")
    texts = t.texts.select(F.col("hash_key").alias("h"), "text")
    scores = t.reviews.select(F.col("id").alias("rid"), "score")
    out = jobs.join(tg, (F.col("id") == F.col("job_id")) & (F.col("round") == F.col("current_round")), "left").join(texts, F.col("hash_key") == F.col("h"), "left").join(scores, F.col("review_id") == F.col("rid"), "left")
    out = out.select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "user_id", "run_mode", "target_order", "kind", F.coalesce("resolution", F.lit("")).alias("resolution"), F.when(F.col("score").isNotNull(), F.format_string("%.4f", "score")).otherwise("").alias("score"), csv_guard(F.coalesce("text", F.lit(""))).alias("text"))
    return out.orderBy(F.desc("id"), "target_order", "kind", "text", "resolution").limit(most)


def audit_users(t: Tables) -> DataFrame:
    """Active users with whether they have jobs and how many: the counts are summed up before the join."""
    n = t.jobs.groupBy("user_id").agg(F.count(F.lit(1)).alias("jobs"))
    return t.users.where("NOT deleted AND status = 'active'").join(n, F.col("id") == F.col("user_id"), "left").select("id", F.lower("username").alias("username"), F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"), F.col("user_id").isNotNull().alias("has_jobs"))


def trust_search(t: Tables, query: str = "12") -> DataFrame:
    known = text_search(t.texts, query)
    return known.join(t.trust.withColumnRenamed("hash_key", "h"), F.col("hash_key") == F.col("h")).select("hash_key", F.left("text", F.lit(500)).alias("preview"))


def breaker_list(t: Tables) -> DataFrame:
    """Breakers with a preview, the users of their hash (the first 20) and whether it is trusted."""
    users = t.targets.where("kind = 'instruction'").join(t.jobs.select("id", "user_id"), F.col("job_id") == F.col("id")).select(F.col("hash_key").alias("h"), "user_id").distinct()
    users = latest_per(users, ["h"], [F.col("user_id")], 20).groupBy("h").agg(F.array_sort(F.collect_list("user_id")).alias("users"))
    texts = t.texts.select(F.col("hash_key").alias("th"), F.left("text", F.lit(500)).alias("preview"))
    out = t.breakers.join(texts, F.col("hash_key") == F.col("th"), "left").join(users, F.col("hash_key") == F.col("h"), "left")
    return flag(out, t.trust, "hash_key", "trusted").select("hash_key", "status", "distinct_users", "preview", F.coalesce(F.array_join(F.transform("users", lambda u: u.cast("string")), ","), F.lit("")).alias("users"), "trusted")


def replay_groups(t: Tables) -> DataFrame:
    """Labelled samples against their replay: misjudged, missed, under review, consistent."""
    group = F.when(F.col("actual") == F.col("expected"), "consistent").when(F.col("actual") == "review", "review").when(F.col("expected") == "pass", "misjudged").otherwise("missed")
    return t.samples.groupBy(group.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def text_hashes(t: Tables) -> DataFrame:
    """Content-addressed prompt texts: one row of each (kind, normal text), the first id as its source."""
    p = t.prompts.select("id", "kind", normalise(F.col("text")).alias("text"))
    return p.groupBy(content_hash(F.col("kind"), F.col("text")).alias("hash")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def similar_prompts(t: Tables) -> DataFrame:
    """Pairs of instruction texts whose SimHashes differ in 3 bits at the most."""
    p = t.prompts.where("kind = 'instruction'").select("id", simhash64("text").alias("simhash"))
    p = p.checkpoint() if t.spark.sparkContext.getCheckpointDir() else p  # four scans of the hashes, else each reads and hashes the texts
    return similar_pairs(p, p).where("a < b")


def similar_pair(t: Tables) -> DataFrame:
    """For each prompt with similar ones of smaller ids the nearest of them (least distance, then id), and what differs line by line."""
    nearest = nearest_before(t.prompts.where("kind = 'instruction'").select("id", simhash64("text").alias("simhash")))
    before, after = (t.prompts.select(F.col("id").alias(f"{k}_id"), F.col("text").alias(f"{k}_text")) for k in "ab")
    pairs = nearest.join(before, F.col("a") == F.col("a_id")).join(after, F.col("b") == F.col("b_id"))
    diff.register(t.spark)
    return t.spark.sql("SELECT p.a, p.b, p.distance, d.* FROM {pairs} p, LATERAL line_diff(p.a_text, p.b_text) d", pairs=pairs)


def similar_by_key(t: Tables) -> DataFrame:
    """The same join on hashes that SQL can make too."""
    h = t.texts.select(F.col("hash_key").alias("id"), (F.col("hash_key") * F.col("hash_key") * 7919 + F.col("size") * 64).alias("simhash"))
    return similar_pairs(h, h).where("a < b")


def top_targets(t: Tables, n: int = 2) -> DataFrame:
    """The heaviest orders' targets of each user: a rank-limited list."""
    return latest_per(t.jobs.select("user_id", "id", "price"), ["user_id"], [F.desc("price"), F.asc("id")], n)


def warning_window(t: Tables, size: int = 5) -> DataFrame:
    """Counted violations among the user's last `size` eligible finished jobs, at each such job."""
    w = Window.partitionBy("user_id").orderBy("id").rowsBetween(-(size - 1), 0)
    jobs = t.jobs.where("status = 'done' AND enforcement_eligible")
    return jobs.select("id", "user_id", F.sum(F.col("violation_counted").cast("long")).over(w).alias("violations"))


def last_points(t: Tables, n: int = 48) -> DataFrame:
    """The last hours' counts in time order, with labels for the first, middle and last."""
    by = t.actions.groupBy(F.date_trunc("hour", "requested_at").alias("hour")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("hour")).limit(n)
    w = Window.orderBy("hour")
    place = F.row_number().over(w)
    return by.withColumn("place", place.cast("long")).withColumn("labelled", F.col("place").isin(1, n // 2 + 1, n))


def key_values(t: Tables) -> DataFrame:
    """Event counts of each user as columns."""
    kinds = ("click", "error", "purchase", "signup", "view")
    return t.actions.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


def latest_latency(t: Tables, keep: int = 1000) -> DataFrame:
    """Nearest-rank percentiles of each node's last `keep` calls."""
    last = latest_per(t.attempts.where("latency_ms IS NOT NULL"), ["model_id"], [F.desc("dispatch_started_at"), F.desc("job_id"), F.desc("line"), F.desc("latency_ms")], keep)
    ranked = last.withColumn("r", F.row_number().over(Window.partitionBy("model_id").orderBy("latency_ms"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("model_id")))
    at = lambda p: F.min(F.when(F.col("r") >= F.ceil(F.col("n") * p), F.col("latency_ms")))
    return ranked.groupBy("model_id").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"))
