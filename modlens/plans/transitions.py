"""Rules of configuration, admission, delivery and state changes, as expressions over the tables of what they act on.

Lists that an administrator gives (excluded users, requested ids, rules of single users) are parameters and stay literals
of the plan; everything else is joined. REPORTS names each with the SQL that must give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.sources.tables import Tables

#: Names of retired stages in policy texts.
LEGACY_MARKERS = ("audit_stage", "intent_binding", "effective_behavior")


# --- configuration ------------------------------------------------------------------------------------------------------


def excluded_by_scope(users: tuple[int, ...], platforms: tuple[str, ...], groups: tuple[int, ...] | None) -> Column:
    """Whether a request (user_id, platform, group_id) is out of scope. No platforms mean all; groups None mean all."""
    out = F.col("user_id").isin(*users)
    if platforms:
        out = out | ~F.coalesce(F.col("platform").isin(*platforms), F.lit(False))
    if groups is not None:
        out = out | ~F.coalesce(F.col("group_id").isin(*groups), F.lit(False))
    return out


def scope(t: Tables) -> DataFrame:
    requests = t.users.select(F.col("id").alias("user_id"), F.when(F.col("id") % 7 > 0, F.col("group_id")).alias("group_id"))
    groups = t.groups.select(F.col("id").alias("gid"), "platform")
    return requests.join(groups, F.col("group_id") == F.col("gid"), "left").select("user_id", excluded_by_scope((1, 2, 3), ("ASIA", "EUROPE"), (8, 9, 12, 18, 21, 7)).alias("excluded"))


def legacy_policy(text: str) -> Column:
    out = F.lit(False)
    for marker in LEGACY_MARKERS:
        out = out | F.contains(text, F.lit(marker))
    return out


def legacy_prompts(t: Tables) -> DataFrame:
    marker = F.element_at(F.array(*[F.lit(m) for m in (*LEGACY_MARKERS, "audit stage", "")]), (1 + F.col("id") % 5).cast("int"))
    return t.prompts.select("id", F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), marker).alias("text")).select("id", legacy_policy("text").alias("legacy"))


def effective_config(t: Tables, mode: str = "blocking", review: float = 0.3, block: float = 0.6) -> DataFrame:
    """Each user's mode and thresholds: a rule of their own wins, and a mode that is off for all stays off."""
    rule = t.users.where("id % 3 = 0").select(F.col("id").alias("rid"), F.when(F.col("id") % 2 == 0, "async").otherwise("").alias("rule_mode"), ((F.col("id") % 5) / 10.0).alias("rr"), (0.5 + (F.col("id") % 5) / 10.0).alias("rb"))
    own = F.when(F.col("rule_mode") != "", F.col("rule_mode")).otherwise(F.lit("async" if mode == "off" else mode))
    chosen = F.lit("off") if mode == "off" else F.when(F.col("rid").isNull(), F.lit(mode)).otherwise(own)
    return t.users.join(rule, F.col("id") == F.col("rid"), "left").select(F.col("id").alias("user_id"), chosen.alias("mode"), F.coalesce("rr", F.lit(review)).alias("review"), F.coalesce("rb", F.lit(block)).alias("block"))


def model_names(t: Tables) -> DataFrame:
    """Names of nodes: the trimmed model, with -n from its second node on; a node without a model has none."""
    model = F.trim(F.concat(F.lit(" m"), (F.col("model_id") % 7).cast("string"), F.lit(" ")))
    rows = t.nodes.select("model_id", F.when(F.col("model_id") % 10 == 0, "").otherwise(model).alias("model"))
    at = F.row_number().over(Window.partitionBy("model").orderBy("model_id")) - 1
    name = F.when(F.col("model") == "", "").when(at > 0, F.concat("model", F.lit("-"), at.cast("string"))).otherwise(F.col("model"))
    return rows.select("model_id", name.alias("name"))


def changed_nodes(t: Tables) -> DataFrame:
    """Nodes of both configurations whose connection differs, and nodes whose key isn't kept."""
    before = t.nodes.where("model_id % 4 <> 0").select(F.col("model_id").alias("old_id"), F.col("enabled").alias("old_enabled"), F.lit("chat").alias("old_format"))
    after = t.nodes.where("model_id % 6 <> 0").select("model_id", (F.col("enabled") & (F.col("model_id") % 5 != 0)).alias("enabled"), F.when(F.col("model_id") % 9 == 0, "messages").when(F.col("model_id") % 2 == 0, "chat").alias("format"))
    both = after.join(before, F.col("model_id") == F.col("old_id"))
    differs = (F.col("enabled") != F.col("old_enabled")) | (F.coalesce("format", F.lit("chat")) != F.col("old_format"))
    keys = t.nodes.where("model_id % 11 = 0").select("model_id")
    return both.where(differs).select("model_id").union(keys).distinct()


def evaluation_hashes(t: Tables) -> DataFrame:
    """The key of review reuse: of policy, contract, version, kind and the enabled nodes in order, for each kind."""
    node = F.to_json(F.struct(F.col("model_id").cast("string").alias("ID"), F.coalesce("name", F.lit("")).alias("Model")))
    nodes = t.nodes.where("enabled").agg(F.transform(F.sort_array(F.collect_list(F.struct("model_id", node.alias("json")))), lambda x: x["json"]).alias("nodes"))
    kinds = F.explode(F.array(F.lit("user"), F.lit("instruction"))).alias("kind")
    text = F.concat(F.lit('{"Policy":"p","Contract":"c","Version":"3","Kind":"'), F.col("kind"), F.lit('","Nodes":['), F.array_join("nodes", ","), F.lit("]}"))
    return nodes.select("nodes", kinds).select("kind", F.sha2(text, 256).alias("evaluation_hash"))


def epochs(t: Tables) -> DataFrame:
    """Revisions of each user's quota settings that begin a new epoch: enabling, or another account while enabled."""
    by = Window.partitionBy("user_id").orderBy("id")
    rows = t.actions.select("user_id", "id", (F.col("event_type") != "error").alias("enabled"), (F.col("id") % 3).alias("account"))
    was, had = F.lag("enabled").over(by), F.lag("account").over(by)
    rows = rows.withColumn("new", F.col("enabled") & (was.isNull() | ~was | (had != F.col("account"))))
    return rows.where("new").select("user_id", "id", F.row_number().over(by).alias("epoch"))


# --- admission ------------------------------------------------------------------------------------------------------------


def bound_decisions(t: Tables) -> DataFrame:
    """What a request gets whose turn is known already."""
    done = F.col("status") == "done"
    kind = F.when(done & (F.col("decision") == "block"), "block").when(done & (F.col("decision") == "review"), "flag").when(done | (F.col("run_mode") == "async"), "allow").otherwise("wait")
    return t.jobs.select("id", kind.alias("kind"), F.when(kind == "block", "third_party_audit_blocked").alias("error_code"))


def shared_flights(t: Tables) -> DataFrame:
    """Of targets that ask for the same hash in one round, the first is scored and the others wait for it."""
    first = F.first("job_id").over(Window.partitionBy("hash_key", "round").orderBy("job_id", "target_order"))
    at = F.row_number().over(Window.partitionBy("hash_key", "round").orderBy("job_id", "target_order"))
    rows = t.targets.where("resolution IS NULL").select("job_id", "target_order", "hash_key", "round")
    return rows.select("job_id", "target_order", first.alias("scored_by"), (at > 1).alias("inflight"))


def failed_transitions(t: Tables) -> DataFrame:
    """What becomes of a job whose evaluation failed: attempts that are left, then automatic retries, then the end."""
    attempts, retries, retryable = 1 + F.col("id") % 4, F.col("price") % 5, F.col("id") % 6 != 0
    auto = F.when(retries == 0, 60).when(retries == 1, 300).otherwise(900)
    state = F.when(retryable & (attempts < 3), "retry").when(retryable & (retries < 3), "auto_retry").otherwise("failed")
    wait = F.when(state == "retry", attempts * attempts).when(state == "auto_retry", auto)
    return t.jobs.where("status = 'failed'").select("id", state.alias("next"), wait.cast("long").alias("wait_s"), F.when(state == "auto_retry", 0).otherwise(attempts).cast("long").alias("attempts"))


def newly_excluded(t: Tables, now: tuple[int, ...] = tuple(range(1, 60)), before: tuple[int, ...] = tuple(range(1, 20))) -> DataFrame:
    """Queued jobs of users who weren't excluded before and have had no call yet."""
    new = sorted(set(now) - set(before))
    called = t.attempts.select(F.col("job_id").alias("called")).distinct()
    waiting = t.jobs.where(F.col("user_id").isin(*new) & F.col("status").isin("queued", "retry") & (F.col("id") % 2 == 0))
    return waiting.join(called, (F.col("id") == F.col("called")) & (F.col("id") % 4 == 0), "left_anti").select("id", F.lit("skipped").alias("status"), F.lit("user_excluded").alias("error_code"))


# --- actions and deliveries -------------------------------------------------------------------------------------------------


def requested_skips(t: Tables, ids: tuple[int, ...] = (5, 3, 999_999_999, 1, 2, 8, 13, 21, 34, 55, 89, 144)) -> DataFrame:
    """Ids whose notice is to be skipped: done for failed ones, a conflict for others, missing; in the order asked for."""
    asked = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("place", "asked"))
    # the list is the small side: it filters the scan, and its ids alone are joined
    rows = t.actions.where(F.col("id").isin(*ids)).select("id", F.when(F.col("execution_status") == "succeeded", "failed").otherwise(F.col("notification_status")).alias("status"))
    outcome = F.when(F.col("id").isNull(), "missing").when(F.col("status") == "failed", "skipped").otherwise("conflict")
    return asked.join(rows, F.col("asked") == F.col("id"), "left").select("place", F.col("asked").alias("id"), outcome.alias("outcome"))


def delivery_status(t: Tables) -> DataFrame:
    """One status of an action's deliveries, and how long the next try waits."""
    one = lambda k: F.struct(F.element_at(F.array(*[F.lit(s) for s in ("sent", "failed", "pending", "sending")]), (1 + F.floor(F.col("id") / k) % 4).cast("int")).alias("status"), (F.col("id") % (k + 8)).alias("tries"))
    rows = t.actions.select("id", F.slice(F.array(one(1), one(3)), 1, (F.col("id") % 3).cast("int")).alias("d"))
    open_ = F.exists("d", lambda x: x["status"].isin("pending", "sending"))
    status = F.when(F.size("d") == 0, "not_required").when(open_, "retry").when(F.exists("d", lambda x: x["status"] == "failed"), "failed").otherwise("sent")
    tries = F.coalesce(F.array_max(F.transform("d", lambda x: x["tries"])), F.lit(0))
    return rows.select("id", status.alias("status"), F.pow(F.lit(2.0), F.least(tries, F.lit(8))).cast("long").alias("wait_s"))


def due_actions(t: Tables, now: str = "2024-01-20 00:00:00", n: int = 50) -> DataFrame:
    """The next actions of the outbox at `now`: not carried out yet, or carried out with a notice to send, whose next attempt is due and which nobody
    holds, in the order of that attempt. The next attempt comes a minute after the request for each unit of value; clicks are held for ten days."""
    notice = F.when(F.col("id") % 4 == 0, "retry").otherwise(F.col("notification_status"))
    open_ = F.col("execution_status").isin("pending", "processing", "unknown") | (F.col("execution_status") == "succeeded") & notice.isin("pending", "processing", "retry")
    rows = t.actions.where(open_).withColumns({"next": F.col("requested_at").cast("timestamp") + F.make_dt_interval(mins=F.floor("value").cast("int")), "lease": F.when(F.col("event_type") == "click", F.col("requested_at").cast("timestamp") + F.expr("INTERVAL 10 DAYS"))})
    at = F.lit(now).cast("timestamp")
    due = rows.where((F.col("next") <= at) & (F.col("lease").isNull() | (F.col("lease") <= at)))
    return due.orderBy("next", "id").limit(n).select("id", F.when(F.col("execution_status") == "processing", "unknown").otherwise(F.col("execution_status")).alias("execution_status"), F.col("next").cast("timestamp_ntz").alias("next_attempt_at"))


def appended_evidence(t: Tables) -> DataFrame:
    """An acknowledgement goes to the end of the evidence list; what was recorded isn't rewritten."""
    items = F.array(F.concat(F.lit("recorded "), F.col("execution_status")))
    out = F.when(F.col("execution_status") == "unknown", F.array_append(items, F.lit("acknowledged"))).otherwise(items)
    return t.actions.select("id", "execution_status", F.array_join(out, "; ").alias("evidence"), F.size(out).cast("long").alias("entries"))


def merged_snapshots(t: Tables) -> DataFrame:
    """Shallow merge of two objects, the right one's values win."""
    left = F.map_from_arrays(F.array(F.lit("status"), F.lit("user")), F.array(F.col("execution_status"), F.col("user_id").cast("string")))
    right = F.map_from_arrays(F.array(F.lit("status"), F.lit("skipped_by")), F.array(F.lit("skipped"), F.lit("9")))
    merged = F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
    return t.actions.where("execution_status = 'failed'").select("id", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


def contained_ids(t: Tables) -> DataFrame:
    """The length of a JSON list of ids, and whether the user is in it."""
    text = F.concat(F.lit("["), (F.col("user_id") % 3).cast("string"), F.lit(","), (F.col("id") % 5).cast("string"), F.lit(", 7]"))
    rows = t.actions.select("id", (F.col("user_id") % 8).alias("u"), text.alias("ids"))
    return rows.select("id", F.json_array_length("ids").cast("long").alias("n"), F.array_contains(F.from_json("ids", "array<long>"), F.col("u")).alias("excluded"))


def notifications(t: Tables) -> DataFrame:
    """The two bodies of a block's notice: the administrators' has the categories, the user's has neither them nor a hash."""
    safe = F.col("username")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    users = t.users.select(F.col("id").alias("uid"), F.concat("username", F.lit(" <a&b>")).alias("username"))
    jobs = t.jobs.where("decision = 'block'").join(users, F.col("user_id") == F.col("uid"))
    admin = F.concat(F.lit("<p>User "), safe, F.lit(" ("), F.col("user_id").cast("string"), F.lit("): job "), F.col("id").cast("string"), F.lit(", category "), F.col("category_code"), F.lit("</p>"))
    return jobs.select("id", admin.alias("admin_body"), F.concat(F.lit("<p>Dear "), safe, F.lit(", a request of yours was blocked.</p>")).alias("user_body"))


def skip_failed_subscriptions(t: Tables) -> DataFrame:
    """Failed items whose subscription is still valid, in the order of items."""
    valid = t.users.where("status = 'active' AND NOT deleted").select(F.col("id").alias("uid"))
    return t.actions.where("execution_status = 'failed'").join(valid, F.col("user_id") == F.col("uid")).select("id", "user_id")


def _batch_state(now: str) -> Column:
    """queued jobs stand for batches in flight; those of over three minutes are uncertain, failed ones wait."""
    late = F.col("created_at").cast("timestamp") < F.expr(f"TIMESTAMP '{now}' - INTERVAL 3 MINUTES")
    return F.when(F.col("status") == "queued", F.when(late, "uncertain").otherwise("inflight")).when(F.col("status") == "failed", "pending").otherwise(F.col("status"))


def recovered_batches(t: Tables, now: str = "1996-06-01 00:03:00") -> DataFrame:
    """A user's batches in flight, and those in flight for over three minutes, whose outcome is uncertain."""
    rows = t.jobs.select("user_id", _batch_state(now).alias("state"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("state") == "uncertain").alias("uncertain"), F.count_if(F.col("state") == "inflight").alias("inflight"))


def claimed_batches(t: Tables, now: str = "1996-06-01 00:03:00") -> DataFrame:
    """Pending batches with whether any other batch of their runtime blocks them, whoever's it is. A day stands for a runtime; each has one row of sums."""
    rows = t.jobs.select("id", F.to_date("created_at").alias("day"), _batch_state(now).alias("state"))
    open_ = rows.groupBy(F.col("day").alias("of_day")).agg(F.count_if(F.col("state").isin("inflight", "uncertain")).alias("open"))
    return rows.where("state = 'pending'").join(open_, F.col("day") == F.col("of_day")).select("id", (F.col("open") > 0).alias("blocked"))


def manual_resets(t: Tables) -> DataFrame:
    """Requests of one key: the first counts, a repeated one is answered with it, another revision is a conflict."""
    key = F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("id") % 3).cast("string"))
    rows = t.actions.select("id", key.alias("key"), (F.col("id") % 2).alias("revision"))
    by = Window.partitionBy("key").orderBy("id")
    first, kept = F.first("id").over(by), F.first("revision").over(by)
    outcome = F.when(F.col("id") == first, "created").when(F.col("revision") == kept, "repeated").otherwise("conflict")
    return rows.select("id", first.alias("reset_id"), outcome.alias("outcome"))


# --- reports ----------------------------------------------------------------------------------------------------------------


def unhealthy_nodes(t: Tables) -> DataFrame:
    """Nodes for the inbox, with the time of their last call or else the end of their cooldown."""
    health = F.element_at(F.array(*[F.lit(h) for h in ("healthy", "degraded", "cooldown", "unknown", "misconfigured")]), (1 + F.col("model_id") % 5).cast("int"))
    last = t.attempts.where("status = 'failed'").groupBy(F.col("model_id").alias("mid")).agg(F.max("dispatch_started_at").alias("seen"))
    rows = t.nodes.select("model_id", F.when(F.col("enabled"), health).otherwise("disabled").alias("health"))
    rows = rows.where(~F.col("health").isin("healthy", "unknown", "disabled")).join(last, F.col("model_id") == F.col("mid"), "left")
    return rows.select("model_id", "health", F.coalesce(F.col("seen").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")).alias("occurred_at"))


def repair_chains(t: Tables) -> DataFrame:
    """Calls with the repair of their format, found by the call that a repair names."""
    calls = t.attempts.select(F.concat_ws("-", "job_id", "line").alias("id"), F.when(F.col("stage") == "format_repair", F.concat_ws("-", "job_id", F.lit(1))).alias("repair_of"), "status")
    chain = calls.select(F.coalesce("repair_of", "id").alias("chain"), F.col("repair_of").isNotNull().alias("repair"), "status")
    by = chain.groupBy("chain").agg(F.count(F.lit(1)).alias("calls"), F.max(F.when(F.col("repair"), F.col("status"))).alias("repair_status"))
    return by.where("calls > 1")


def misses_with_churn(t: Tables) -> DataFrame:
    """Clients' share of targets without a cached result, beside the number of distinct hashes that they send."""
    rows = t.targets.join(t.jobs.select("id", F.col("client_fingerprint").alias("client")), F.col("job_id") == F.col("id"))
    misses = rows.groupBy("client").agg(F.count_if(F.coalesce("resolution", F.lit("")) != "cache").alias("misses"), F.count(F.lit(1)).alias("n"))
    churn = rows.where("kind = 'instruction'").select("client", "hash_key").distinct().groupBy(F.col("client").alias("c")).agg(F.count("hash_key").alias("hashes"))
    return misses.join(churn, F.col("client") == F.col("c"), "left").select("client", (F.col("misses") / F.col("n")).alias("miss_rate"), F.coalesce("hashes", F.lit(0)).alias("hashes"))


def replay_comparison(t: Tables) -> DataFrame:
    """Results of a user's run beside those of the last finished one before it."""
    by = Window.partitionBy("user_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("status") == "done", F.struct("id", "decision")), ignorenulls=True).over(by)
    rows = t.jobs.select("id", "status", "decision", before.alias("b"))
    return rows.where("status = 'done'").select("id", F.col("b.id").alias("before"), (F.coalesce(F.col("b.decision"), F.col("decision")) != F.col("decision")).alias("changed"))


def page_with_total(t: Tables, size: int = 20) -> DataFrame:
    """A page of blocked jobs and, in each row, how many there are."""
    blocked = t.jobs.where("decision = 'block'")
    total = blocked.agg(F.count(F.lit(1)).alias("total"))
    return blocked.orderBy(F.desc("id")).limit(size).select("id", "user_id").join(F.broadcast(total))


def ordered_targets(t: Tables) -> DataFrame:
    """A job's targets as they are shown: the user's first, then in their order."""
    at = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc(F.col("kind") == "user"), "target_order"))
    return t.targets.where("kind IS NOT NULL").select("job_id", "target_order", at.alias("place"))


def replay_estimate(t: Tables) -> DataFrame:
    samples, nodes = t.samples.agg(F.count(F.lit(1)).alias("samples")), t.nodes.agg(F.count_if("enabled").alias("enabled_nodes"))
    return samples.join(F.broadcast(nodes)).select("*", (F.col("samples") * F.col("enabled_nodes")).alias("planned_calls"))


_D = "list_extract(['sent', 'failed', 'pending', 'sending'], CAST(1 + {} % 4 AS BIGINT))"
REPORTS = [
    ("b11_scope", scope, "SELECT user_id, user_id IN (1, 2, 3) OR NOT coalesce(platform IN ('ASIA', 'EUROPE'), false) OR NOT coalesce(group_id IN (8, 9, 12, 18, 21, 7), false) AS excluded FROM (SELECT id AS user_id, CASE WHEN id % 7 > 0 THEN group_id END AS group_id FROM users) LEFT JOIN (SELECT id AS gid, platform FROM grps) ON group_id = gid"),
    ("b21_unhealthy_nodes", unhealthy_nodes, "SELECT model_id, health, coalesce(seen::TIMESTAMP, TIMESTAMP '1999-01-01') AS occurred_at FROM (SELECT model_id, CASE WHEN enabled THEN list_extract(['healthy', 'degraded', 'cooldown', 'unknown', 'misconfigured'], 1 + model_id % 5) ELSE 'disabled' END AS health FROM nodes) LEFT JOIN (SELECT model_id AS mid, max(dispatch_started_at) AS seen FROM attempts WHERE status = 'failed' GROUP BY 1) ON mid = model_id WHERE health NOT IN ('healthy', 'unknown', 'disabled')"),
    ("b23_legacy_prompts", legacy_prompts, "SELECT id, id % 5 < 3 AS legacy FROM prompts"),
    ("c15_repair_chains", repair_chains, "SELECT * FROM (SELECT coalesce(r, i) AS chain, count(*) AS calls, max(CASE WHEN r IS NOT NULL THEN status END) AS repair_status FROM (SELECT job_id || '-' || line AS i, CASE WHEN stage = 'format_repair' THEN job_id || '-1' END AS r, status FROM attempts) GROUP BY 1) WHERE calls > 1"),
    ("c18_misses_with_churn", misses_with_churn, "SELECT client_fingerprint AS client, count(*) FILTER (WHERE coalesce(resolution, '') <> 'cache') / count(*)::DOUBLE AS miss_rate, count(DISTINCT hash_key) FILTER (WHERE kind = 'instruction') AS hashes FROM targets JOIN jobs ON id = job_id GROUP BY 1"),
    ("c19_replay_comparison", replay_comparison, "SELECT id, b AS before, coalesce(d, decision) <> decision AS changed FROM (SELECT *, last_value(CASE WHEN status = 'done' THEN id END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN status = 'done' THEN decision END IGNORE NULLS) OVER w AS d FROM jobs WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE status = 'done'"),
    ("c21_requested_skips", requested_skips, "SELECT place::INTEGER AS place, asked AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN execution_status = 'succeeded' OR notification_status = 'failed' THEN 'skipped' ELSE 'conflict' END AS outcome FROM (SELECT unnest([5, 3, 999999999, 1, 2, 8, 13, 21, 34, 55, 89, 144])::BIGINT AS asked, unnest(range(12)) AS place) LEFT JOIN actions a ON a.id = asked"),
    ("c22_failed_and_valid", skip_failed_subscriptions, "SELECT a.id, user_id FROM actions a JOIN users u ON u.id = user_id WHERE execution_status = 'failed' AND u.status = 'active' AND NOT deleted"),
    ("d28_delivery_status", delivery_status, f"SELECT id, CASE WHEN id % 3 = 0 THEN 'not_required' WHEN a IN ('pending', 'sending') OR id % 3 = 2 AND b IN ('pending', 'sending') THEN 'retry' WHEN a = 'failed' OR id % 3 = 2 AND b = 'failed' THEN 'failed' ELSE 'sent' END AS status, CAST(pow(2, least(8, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN id % 9 ELSE greatest(id % 9, id % 11) END)) AS BIGINT) AS wait_s FROM (SELECT id, {_D.format('id')} AS a, {_D.format('(id // 3)')} AS b FROM actions)"),
    ("d29_page_with_total", page_with_total, "SELECT id, user_id, total FROM (SELECT id, user_id, count(*) OVER () AS total FROM jobs WHERE decision = 'block') ORDER BY id DESC LIMIT 20"),
    ("e13_ordered_targets", ordered_targets, "SELECT job_id, target_order, row_number() OVER (PARTITION BY job_id ORDER BY kind = 'user' DESC, target_order)::INTEGER AS place FROM targets"),
    ("f15_evaluation_hashes", evaluation_hashes, """SELECT kind, sha256('{"Policy":"p","Contract":"c","Version":"3","Kind":"' || kind || '","Nodes":[' || nodes || ']}') AS evaluation_hash FROM (SELECT string_agg('{"ID":"' || model_id || '","Model":"' || coalesce(name, '') || '"}', ',' ORDER BY model_id) AS nodes FROM nodes WHERE enabled), (SELECT unnest(['user', 'instruction']) AS kind)"""),
    ("f23_effective_config", effective_config, "SELECT id AS user_id, CASE WHEN id % 6 = 0 THEN 'async' ELSE 'blocking' END AS mode, CASE WHEN id % 3 = 0 THEN (id % 5) / 10.0::DOUBLE ELSE 0.3 END AS review, CASE WHEN id % 3 = 0 THEN 0.5::DOUBLE + (id % 5) / 10.0::DOUBLE ELSE 0.6 END AS block FROM users"),
    ("f25_model_names", model_names, "SELECT model_id, CASE WHEN m = '' THEN '' WHEN r > 0 THEN m || '-' || r ELSE m END AS name FROM (SELECT model_id, m, row_number() OVER (PARTITION BY m ORDER BY model_id) - 1 AS r FROM (SELECT model_id, CASE WHEN model_id % 10 = 0 THEN '' ELSE 'm' || (model_id % 7) END AS m FROM nodes))"),
    ("f32_appended_evidence", appended_evidence, "SELECT id, execution_status, 'recorded ' || execution_status || CASE WHEN execution_status = 'unknown' THEN '; acknowledged' ELSE '' END AS evidence, CASE WHEN execution_status = 'unknown' THEN 2 ELSE 1 END::BIGINT AS entries FROM actions"),
    ("f33_merged_snapshots", merged_snapshots, "SELECT id, 'skipped_by=9,status=skipped,user=' || user_id AS merged FROM actions WHERE execution_status = 'failed'"),
    ("f35_contained_ids", contained_ids, "SELECT id, 3::BIGINT AS n, user_id % 8 IN (user_id % 3, id % 5, 7) AS excluded FROM actions"),
    ("f36_notifications", notifications, "SELECT j.id, '<p>User ' || username || ' &lt;a&amp;b&gt; (' || user_id || '): job ' || j.id || ', category ' || category_code || '</p>' AS admin_body, '<p>Dear ' || username || ' &lt;a&amp;b&gt;, a request of yours was blocked.</p>' AS user_body FROM jobs j JOIN users u ON u.id = user_id WHERE decision = 'block'"),
    ("f40_changed_nodes", changed_nodes, "SELECT model_id FROM nodes WHERE model_id % 11 = 0 OR model_id % 4 <> 0 AND model_id % 6 <> 0 AND (enabled AND model_id % 5 = 0 OR model_id % 9 = 0)"),
    ("g4_bound_decisions", bound_decisions, "SELECT id, CASE WHEN decision = 'block' THEN 'block' WHEN decision = 'review' THEN 'flag' WHEN status = 'done' OR run_mode = 'async' THEN 'allow' ELSE 'wait' END AS kind, CASE WHEN decision = 'block' THEN 'third_party_audit_blocked' END AS error_code FROM jobs"),
    ("g5_shared_flights", shared_flights, "SELECT job_id, target_order, first_value(job_id) OVER w AS scored_by, row_number() OVER w > 1 AS inflight FROM targets WHERE resolution IS NULL WINDOW w AS (PARTITION BY hash_key, round ORDER BY job_id, target_order)"),
    ("g12_failed_transitions", failed_transitions, "SELECT id, s AS next, CASE s WHEN 'retry' THEN a * a WHEN 'auto_retry' THEN CASE r WHEN 0 THEN 60 WHEN 1 THEN 300 ELSE 900 END END::BIGINT AS wait_s, CASE WHEN s = 'auto_retry' THEN 0 ELSE a END::BIGINT AS attempts FROM (SELECT id, 1 + id % 4 AS a, price % 5 AS r, CASE WHEN id % 6 <> 0 AND 1 + id % 4 < 3 THEN 'retry' WHEN id % 6 <> 0 AND price % 5 < 3 THEN 'auto_retry' ELSE 'failed' END AS s FROM jobs WHERE status = 'failed')"),
    (
        "g22_claimed_batches",
        claimed_batches,
        "SELECT id, EXISTS (SELECT 1 FROM jobs o WHERE o.id <> j.id AND o.created_at::DATE = j.created_at::DATE AND o.status = 'queued') AS blocked FROM jobs j WHERE status = 'failed'",
    ),
    ("g23_recovered_batches", recovered_batches, "SELECT user_id, count(*) FILTER (WHERE s = 'uncertain') AS uncertain, count(*) FILTER (WHERE s = 'inflight') AS inflight FROM (SELECT user_id, CASE WHEN status = 'queued' THEN CASE WHEN created_at < TIMESTAMP '1996-06-01 00:00:00' THEN 'uncertain' ELSE 'inflight' END ELSE status END AS s FROM jobs) GROUP BY 1"),
    ("g29_replay_estimate", replay_estimate, "SELECT samples, enabled_nodes, samples * enabled_nodes AS planned_calls FROM (SELECT count(*) AS samples FROM samples), (SELECT count(*) FILTER (WHERE enabled) AS enabled_nodes FROM nodes)"),
    (
        "g31_due_actions",
        due_actions,
        "SELECT id, execution_status, next_attempt_at FROM (SELECT *, requested_at + to_minutes(floor(value)::BIGINT) AS next_attempt_at, CASE WHEN event_type = 'click' THEN requested_at + INTERVAL 10 DAY END AS lease FROM actions) WHERE (execution_status IN ('pending', 'processing', 'unknown') OR execution_status = 'succeeded' AND id % 4 = 0) "
        "AND next_attempt_at <= TIMESTAMP '2024-01-20' AND (lease IS NULL OR lease <= TIMESTAMP '2024-01-20') ORDER BY next_attempt_at, id LIMIT 50",
    ),
    ("g32_newly_excluded", newly_excluded, "SELECT id, 'skipped' AS status, 'user_excluded' AS error_code FROM jobs WHERE user_id BETWEEN 20 AND 59 AND status IN ('queued', 'retry') AND id % 2 = 0 AND NOT (id % 4 = 0 AND id IN (SELECT job_id FROM attempts))"),
    ("g36_manual_resets", manual_resets, "SELECT id, f AS reset_id, CASE WHEN id = f THEN 'created' WHEN id % 2 = f % 2 THEN 'repeated' ELSE 'conflict' END AS outcome FROM (SELECT id, min(id) OVER (PARTITION BY user_id, id % 3) AS f FROM actions)"),
    ("g37_epochs", epochs, "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id)::INTEGER AS epoch FROM (SELECT *, lag(e) OVER w AS was, lag(a) OVER w AS had FROM (SELECT user_id, id, event_type <> 'error' AS e, id % 3 AS a FROM actions) WINDOW w AS (PARTITION BY user_id ORDER BY id)) WHERE e AND (was IS NULL OR NOT was OR had <> a)"),
]
