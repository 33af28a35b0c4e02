"""Quota follow: subscriptions, resets, their fan-out and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlens.functions.decisions import monitor_problems
from modlens.operators.relational import numbered_batches
from modlens.sources.tables import Tables

WINDOWS = ("daily", "weekly", "monthly")
BATCH = 100


def subscriptions(t: Tables) -> DataFrame:
    """Subscriptions of valid users of valid groups: customers stand for them."""
    users = t.users.where("NOT deleted AND status = 'active' AND role = 'user'").select(F.col("id").alias("subscription_id"), F.col("id").alias("user_id"), "group_id", "username")
    groups = t.groups.where("platform IN ('ASIA', 'EUROPE')").select(F.col("id").alias("gid"), "platform")
    return users.join(groups, F.col("group_id") == F.col("gid")).select("subscription_id", "user_id", "group_id", "username", "platform")


def by_group(t: Tables) -> DataFrame:
    return subscriptions(t).groupBy("group_id", "platform").agg(F.count(F.lit(1)).alias("n"))


def reset_events(t: Tables) -> DataFrame:
    """Reset events: the failed actions of a user's day stand for them; an event key counts once."""
    e = t.actions.where("execution_status = 'failed'").select("id", F.concat_ws(":", F.lit("automatic"), F.col("user_id").cast("string"), F.date_format("requested_at", "yyyy-MM-dd")).alias("event_key"), "user_id", F.col("requested_at").alias("reset_at"))
    return e.groupBy("event_key").agg(F.min("id").alias("event_id"), F.min_by("user_id", "id").alias("monitor"), F.min_by("reset_at", "id").alias("reset_at"))


def fan_out(t: Tables) -> DataFrame:
    """Batches of the newest event of each group's monitor: group, batch, items and their windows' records."""
    b = numbered_batches(subscriptions(t), "group_id", "subscription_id", BATCH)
    r = b.withColumn("window", F.explode(F.array(*[F.lit(w) for w in WINDOWS])))
    return r.groupBy("group_id", "batch").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("subscription_id").alias("items"), F.min("subscription_id").alias("first"))


def superseded(t: Tables) -> DataFrame:
    """Events with whether a newer one of the same monitor makes their pending batches pointless."""
    w = Window.partitionBy("monitor")
    return reset_events(t).select("event_id", "monitor", F.when(F.col("event_id") < F.max("event_id").over(w), "skipped").otherwise("pending").alias("status"))


def delivered(t: Tables) -> DataFrame:
    """Items against the replies: without a reply uncertain, else what the reply says; the batch is as bad as its worst item."""
    items = numbered_batches(subscriptions(t), "group_id", "subscription_id", BATCH)
    replies = t.jobs.groupBy(F.col("user_id").alias("rid")).agg(F.max_by("status", "id").alias("last"))
    status = F.when(F.col("last").isNull(), "uncertain").when(F.col("last") == "failed", "failed").otherwise("succeeded")
    got = items.join(replies, F.col("subscription_id") == F.col("rid"), "left").withColumn("status", status)
    worst = F.max(F.when(F.col("status") == "uncertain", 2).when(F.col("status") == "failed", 1).otherwise(0))
    by = got.groupBy("group_id", "batch").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), worst.alias("worst"))
    return by.select("group_id", "batch", "items", "succeeded", F.when(F.col("worst") == 2, "uncertain").when(F.col("worst") == 1, "partial").otherwise("succeeded").alias("status"))


def requalified(t: Tables) -> DataFrame:
    """Frozen items against the present subscriptions: gone, moved to another group, or valid."""
    frozen = t.users.where("role = 'user'").select(F.col("id").alias("item"), ((F.col("group_id") + F.when(F.col("id") % 10 == 0, 1).otherwise(0)) % 25).alias("old_group"))
    now = subscriptions(t).select("subscription_id", "group_id")
    j = frozen.join(now, F.col("item") == F.col("subscription_id"), "left")
    return j.select("item", F.when(F.col("subscription_id").isNull(), "gone").when(~F.col("old_group").eqNullSafe(F.col("group_id")), "moved").otherwise("valid").alias("state"))


def reset_records(t: Tables, keyword: str = "") -> DataFrame:
    """Records of all windows, with the window's own usage, by a keyword in name or ids; none means all."""
    r = subscriptions(t).withColumn("window", F.explode(F.array(*[F.lit(w) for w in WINDOWS])))
    snapshot = F.to_json(F.struct((F.col("user_id") * 2).alias("daily_usage_usd"), (F.col("user_id") * 3).alias("weekly_usage_usd"), (F.col("user_id") * 5).alias("monthly_usage_usd")))
    r = r.withColumn("s", snapshot)
    usage = F.lit(None).cast("string")
    for w in WINDOWS:
        usage = F.when(F.col("window") == w, F.get_json_object("s", f"$.{w}_usage_usd")).otherwise(usage)
    hit = F.col("username").ilike(f"%{keyword}%") | F.col("user_id").cast("string").ilike(f"%{keyword}%")
    return r.where(hit).select("subscription_id", "window", usage.alias("usage"))


def monitor_candidates(t: Tables) -> DataFrame:
    """Accounts with the checks they fail."""
    checks = {"inactive": F.col("status") == "active", "deleted": ~F.col("deleted"), "not_user": F.col("role") == "user", "overdrawn": F.col("balance") >= 0}
    return t.users.select("id", F.array_join(monitor_problems(checks), ",").alias("problems"))


def legacy_groups(t: Tables) -> DataFrame:
    return subscriptions(t).select("platform", "group_id").distinct()


def rate_windows(t: Tables, most: int = 2) -> DataFrame:
    """Requests of each user in a fixed minute, and how many are over the limit."""
    by = t.actions.groupBy("user_id", F.date_trunc("minute", "requested_at").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", "minute", "n", F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("rejected"))
