"""Views of the console in full: the job list with its total, the export, configuration changes, valid subscriptions, the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.functions.text import csv_guard
from modlens.operators.filters import JobFilter
from modlens.operators.relational import page
from modlens.sources.sinks import rfc3339
from modlens.sources.tables import Tables

EXPORT = (
    "job_id created_at user_id api_key_id platform protocol mode status decision trigger request_id target_order target_kind resolution target_decision score reason bytes text"
).split()


def placed_jobs(t: Tables) -> DataFrame:
    """Jobs with the group and platform of their user."""
    users = t.users.select(F.col("id").alias("uid"), F.col("group_id"))
    groups = t.quota_groups.select(F.col("id").alias("gid"), "platform")
    return t.jobs.join(users, F.col("user_id") == F.col("uid"), "left").join(groups, F.col("group_id") == F.col("gid"), "left").drop("uid", "gid")


def job_page(t: Tables, wanted: JobFilter, number: int = 1, size: int = 50) -> DataFrame:
    """A page of the jobs that pass a filter, newest first, with how many there are (total)."""
    found = wanted.apply(placed_jobs(t)).select("id", "user_id", "api_key_id", "group_id", "platform", "request_id", "model", "status", "decision", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    rows = page(found, [F.desc("created_at"), F.desc("id")], number, size)
    return rows.join(found.agg(F.count(F.lit(1)).alias("total")), how="inner")


def export_page(t: Tables, wanted: JobFilter, limit: int = 1000, offset: int = 0) -> DataFrame:
    """The 19 columns of the export, newest jobs first and their targets in order, with has_more: whether the page is full. Ranks and limits come before
    texts and scores are joined, so those are looked up for the page's rows only."""
    if not 0 < limit <= 5000 or offset < 0:
        raise ValueError("limit is from 1 to 5000, offset is not negative")
    jobs = wanted.apply(placed_jobs(t)).select("id", "created_at", "user_id", "api_key_id", "platform", "protocol", "run_mode", "status", "decision", "request_id", "current_round")
    targets = t.targets.select("job_id", "round", "target_order", F.col("kind").alias("target_kind"), "hash_key", "resolution", F.col("decision").alias("target_decision"), "review_id")
    rows = jobs.join(targets, (F.col("id") == F.col("job_id")) & (F.col("round") == F.col("current_round")), "left")
    rows = rows.orderBy(F.desc("id"), F.asc_nulls_last("target_order"), "hash_key", "resolution", "target_decision", "review_id").offset(offset).limit(limit)
    texts = t.texts.select(F.col("hash_key").alias("h"), "text")
    scores = t.reviews.select(F.col("id").alias("rid"), "score")
    out = rows.join(texts, F.col("hash_key") == F.col("h"), "left").join(scores, F.col("review_id") == F.col("rid"), "left")
    empty = F.lit("")
    trigger = F.when(F.col("decision") == "block", F.when(F.col("id") % 2 == 0, "user").otherwise("instruction")).otherwise("")
    cells = {
        "job_id": F.col("id"), "created_at": rfc3339(F.col("created_at")), "user_id": F.col("user_id"), "api_key_id": F.col("api_key_id"), "platform": F.col("platform"), "protocol": F.col("protocol"), "mode": F.col("run_mode"),
        "status": F.col("status"), "decision": F.col("decision"), "trigger": trigger, "request_id": F.col("request_id"), "target_order": F.col("target_order"), "target_kind": F.col("target_kind"), "resolution": F.col("resolution"),
        "target_decision": F.col("target_decision"), "score": F.when(F.col("score").isNotNull(), F.format_string("%.4f", "score")), "reason": F.when(F.col("score") >= 0.6, "over the limit"),
        "bytes": F.coalesce(F.octet_length("text"), F.lit(0)), "text": csv_guard(F.coalesce("text", empty)),
    }
    full = F.count(F.lit(1)).over(Window.partitionBy()) == limit  # over the page's rows, 5000 at the most
    return out.select(*[F.coalesce(cells[c].cast("string"), empty).alias(c) for c in EXPORT], full.alias("has_more"))


def node_semantics(nodes: DataFrame) -> DataFrame:
    """One row: what of the enabled nodes counts for a review, as JSON, in their order. Nodes are configuration, not data: their list is one value."""
    q = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    names = {"ID": "model_id", "BaseURL": "base_url", "Model": "model", "APIFormat": "api_format", "TimeoutMS": "timeout_ms"}
    node = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), q(F.col(c).cast("string"))) for k, c in names.items()]), F.lit("}"))
    listed = F.array_sort(F.collect_list(F.when(F.col("enabled"), F.struct("model_id", node.alias("json")))))
    return nodes.agg(F.array_join(F.transform(listed, lambda x: x["json"]), ",").alias("nodes"))


def evaluation_hash(policy: Column, nodes: Column, kind: str, contract: str = "contract", version: str = "3") -> Column:
    """The key of review reuse: SHA-256 of policy, contract, version, kind and the enabled nodes' semantics."""
    q = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    parts = [F.lit('{"Policy":'), q(policy), F.lit(f',"Contract":"{contract}","Version":"{version}","Kind":"{kind}","Nodes":['), nodes, F.lit("]}")]
    return F.sha2(F.concat(*parts), 256)


def config_impact(t: Tables, drafts: dict[str, tuple[str, str | None, str | None]], since: str = "2001-01-01") -> DataFrame:
    """What each draft of a configuration changes: draft, parts (policy, nodes), the two evaluation hashes, whether they change, and how many
    untrusted instruction blocks the window since `since` has, which would be audited anew.

    drafts: name to (policy, timeout_ms, enabled), a node's new values as SQL over the saved ones, None to keep them. The saved policy is "policy".
    """
    saved = node_semantics(t.node_configs).select(F.col("nodes").alias("saved"))
    recent = t.targets.where("kind = 'instruction'").join(t.jobs.where(F.col("created_at") > F.lit(since).cast("timestamp_ntz")).select("id"), F.col("job_id") == F.col("id"), "left_semi")
    blocks = recent.select("hash_key").distinct().join(t.trust, "hash_key", "left_anti").agg(F.count(F.lit(1)).alias("recent_blocks"))
    out = None
    for name, (policy, timeout, enabled) in drafts.items():
        changed = t.node_configs.withColumns({"timeout_ms": F.expr(timeout or "timeout_ms"), "enabled": F.expr(enabled or "enabled")})
        row = node_semantics(changed).join(saved, how="inner")  # two single rows
        parts = F.array_compact(F.array(F.when(F.lit(policy != "policy"), "policy"), F.when(F.col("nodes") != F.col("saved"), "nodes")))
        hashes = [(evaluation_hash(F.lit("policy"), F.col("saved"), k), evaluation_hash(F.lit(policy), F.col("nodes"), k)) for k in ("user", "instruction")]
        row = row.select(F.lit(name).alias("draft"), F.array_join(parts, ",").alias("parts"), hashes[0][1].alias("user_hash"), hashes[1][1].alias("instruction_hash"), (hashes[0][0] != hashes[0][1]).alias("user_changed"), (hashes[1][0] != hashes[1][1]).alias("instruction_changed"))
        out = row if out is None else out.unionByName(row)
    return out.join(blocks, how="inner")


def valid_subscriptions(t: Tables, now: str = "1997-01-01") -> DataFrame:
    """Subscriptions that count at `now`: not deleted, active, not run out (a year from their start); of active users who aren't deleted, no administrators; in
    active groups of the platform openai that sell subscriptions and aren't deleted."""
    subs = t.subscriptions.where("NOT deleted AND status = 'active'").where(F.add_months("starts_at", 12).cast("timestamp_ntz") > F.lit(now).cast("timestamp_ntz"))
    users = t.users.where("NOT deleted AND status = 'active' AND role = 'user'").select(F.col("id").alias("uid"), "username")
    groups = t.quota_groups.where("NOT deleted AND status = 'active' AND platform = 'openai' AND subscription_type = 'subscription'").select(F.col("id").alias("gid"), F.col("name").alias("group_name"))
    out = subs.join(users, F.col("user_id") == F.col("uid")).join(groups, F.col("group_id") == F.col("gid"))
    return out.select("id", "user_id", "group_id", "group_name", "username", F.format_string("%.2f", "used").alias("monthly_usage"), F.add_months("starts_at", 12).cast("timestamp_ntz").alias("expires_at"))


def group_counts(t: Tables) -> DataFrame:
    """Valid subscriptions by group, with their total beside each; most first."""
    by = valid_subscriptions(t).groupBy("group_id", "group_name").agg(F.count(F.lit(1)).alias("n"))
    return by.join(by.agg(F.sum("n").alias("total")), how="inner")


def inbox_board(t: Tables, calls: DataFrame, as_of: str = "2024-01-20", days: int = 7, rate: float = 0.2, least: int = 5) -> DataFrame:
    """What waits for an operator, a row of each category: category, n, newest (when its newest case happened). failure_rate is there only while the last
    day's failed actions are `rate` of all or more, of `least` at least; total adds up.

    calls: the node health fold's rows (model_id, at_s, health, calls), of which each node's last counts.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = F.col("requested_at") >= now - F.make_dt_interval(days=F.lit(days))
    failed, unsent = F.col("execution_status").isin("failed", "unknown"), (F.col("notification_status") == "failed") & recent
    last_day = F.col("requested_at").between(now - F.make_dt_interval(days=F.lit(1)), now)
    a = t.actions.agg(
        F.count_if(failed).alias("failed"), F.max(F.when(failed, F.col("requested_at"))).alias("failed_at"), F.count_if(unsent).alias("unsent"), F.max(F.when(unsent, F.col("requested_at"))).alias("unsent_at"),
        F.count_if(last_day).alias("day"), F.count_if(last_day & (F.col("execution_status") == "failed")).alias("day_failed"), F.max(F.when(last_day, F.col("requested_at"))).alias("day_at"),
    )
    none = F.lit(None).cast("timestamp_ntz")
    line = lambda name, n, at: F.struct(F.lit(name).alias("category"), n.cast("long").alias("n"), at.cast("timestamp_ntz").alias("newest"))
    over = (F.col("day") >= least) & (F.col("day_failed") / F.col("day") >= rate)
    rows = a.select(F.inline(F.array_compact(F.array(line("action_failed", F.col("failed"), F.col("failed_at")), line("notification_failed", F.col("unsent"), F.col("unsent_at")), F.when(over, line("failure_rate", F.lit(1), F.col("day_at")))))))
    rows = rows.unionByName(t.breakers.where("status = 'tripped'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("breaker_pending").alias("category"), "n", none.alias("newest")))
    last = calls.groupBy("model_id").agg(F.max_by(F.struct("health", "at_s"), "calls").alias("last")).where("last.health NOT IN ('healthy', 'unknown', 'disabled')")
    rows = rows.unionByName(last.agg(F.count(F.lit(1)).alias("n"), F.max("last.at_s").alias("at")).select(F.lit("node_unhealthy").alias("category"), "n", F.timestamp_seconds("at").cast("timestamp_ntz").alias("newest")))
    return rows.unionByName(rows.agg(F.sum("n").alias("n"), F.max("newest").alias("newest")).select(F.lit("total").alias("category"), "n", "newest"))


def claimable_jobs(t: Tables, now: str = "1996-01-01", may_evaluate: bool = True, n: int = 50) -> DataFrame:
    """The next jobs that a worker may claim at `now`, with whether the claim costs an attempt: queued, due, and either complete (all targets of the round resolved, or
    one of them blocked) or, while evaluation is allowed, async or a repeated audit with attempts left or a pause behind it.

    The next attempt is a minute after the creation for each price unit modulo 600; attempts and pauses come from the price too.
    """
    jobs = t.jobs.where("status = 'queued'").withColumns({"next": F.col("created_at").cast("timestamp") + F.make_dt_interval(mins=(F.col("price") % 600).cast("int")), "attempts": F.col("price") % 5, "paused": F.col("price") % 4 == 0})
    jobs = jobs.where(F.col("next") <= F.lit(now).cast("timestamp")).select("id", "current_round", "run_mode", "run_kind", "next", "attempts", "paused")
    targets = t.targets.groupBy("job_id", "round").agg(F.count_if(F.col("resolution").isNull()).alias("open"), F.count_if(F.col("decision") == "block").alias("blocked"))
    rows = jobs.join(targets, (F.col("id") == F.col("job_id")) & (F.col("current_round") == F.col("round")), "left")
    ready = (F.coalesce("open", F.lit(0)) == 0) | (F.coalesce("blocked", F.lit(0)) > 0)
    may = F.lit(may_evaluate) & ((F.col("run_mode") == "async") | (F.col("run_kind") == "reaudit")) & ((F.col("attempts") < 3) | F.col("paused"))
    due = rows.where(ready | may).orderBy("next", "id").limit(n)
    return due.select("id", F.col("next").cast("timestamp_ntz").alias("next_attempt_at"), (~ready & ~F.col("paused")).alias("costs"))


def event_board(t: Tables, number: int = 1, size: int = 100) -> DataFrame:
    """Reset events, newest first, with their batches: an event is open while one of them waits or is in flight, then as bad as its worst one. A day's jobs
    stand for an event's batches: queued ones are in flight, blocked ones uncertain, ones under review partial."""
    state = F.when(F.col("status") == "queued", "inflight").when(F.col("status") == "failed", "failed").when(F.col("decision") == "block", "uncertain").when(F.col("decision") == "review", "partial").otherwise("succeeded")
    by = t.jobs.select(F.to_date("created_at").alias("event"), state.alias("state"), "user_id").groupBy("event")
    has = lambda *names: F.count_if(F.col("state").isin(*names))
    rows = by.agg(F.count(F.lit(1)).alias("batches"), F.countDistinct("user_id").alias("subscriptions"), has("pending", "inflight").alias("open"), has("uncertain", "reviewed").alias("uncertain"), has("partial", "failed").alias("partial"))
    status = F.when(F.col("open") > 0, "pending").when(F.col("uncertain") > 0, "uncertain").when(F.col("partial") > 0, "partial").otherwise("completed")
    return page(rows.select("event", "batches", "subscriptions", "open", status.alias("status")), [F.desc("event")], number, size)


DRAFTS = {
    "same": ("policy", None, None),
    "policy": ("policy, but stricter \"<now>\"", None, None),
    "timeouts": ("policy", "timeout_ms + CASE WHEN model_id % 3 = 0 THEN 500 ELSE 0 END", None),
    "off": ("policy", None, "enabled AND model_id > 2"),
    "idle": ("policy", "CASE WHEN enabled THEN timeout_ms ELSE 1 END", None),
}
_NODE = """'{{"ID":"' || model_id || '","BaseURL":"' || base_url || '","Model":"' || model || '","APIFormat":"' || api_format || '","TimeoutMS":"' || {timeout} || '"}}'"""
_FORMS = " UNION ALL ".join(
    f"SELECT '{d}' AS draft, '{p}' AS policy, coalesce(string_agg({_NODE.format(timeout=timeout)}, ',' ORDER BY model_id) FILTER ({on}), '') AS nodes FROM node_configs"
    for d, p, timeout, on in (
        ("same", "policy", "timeout_ms", "enabled"), ("policy", 'policy, but stricter \\"<now>\\"', "timeout_ms", "enabled"), ("timeouts", "policy", "(timeout_ms + CASE WHEN model_id % 3 = 0 THEN 500 ELSE 0 END)", "enabled"),
        ("off", "policy", "timeout_ms", "enabled AND model_id > 2"), ("idle", "policy", "CASE WHEN enabled THEN timeout_ms ELSE 1 END", "enabled"),
    )
)
_HASH = """sha256('{{"Policy":"' || f.policy || '","Contract":"contract","Version":"3","Kind":"{k}","Nodes":[' || f.nodes || ']}}')"""
_VALID = "FROM subscriptions s JOIN users u ON u.id = s.user_id JOIN quota_groups g ON g.id = s.group_id WHERE NOT s.deleted AND s.status = 'active' AND s.starts_at + INTERVAL 12 MONTH > TIMESTAMP '1997-01-01' AND NOT u.deleted AND u.status = 'active' AND u.role = 'user' AND NOT g.deleted AND g.status = 'active' AND g.platform = 'openai' AND g.subscription_type = 'subscription'"
_PLACED = "jobs j LEFT JOIN users u ON u.id = j.user_id LEFT JOIN quota_groups g ON g.id = u.group_id"

REPORTS = [
    (
        "h1_job_page",
        lambda t: job_page(t, JobFilter(platform="openai", model="model-2", status="done", since="1995-06-01"), 2, 20),
        f"SELECT j.id, j.user_id, api_key_id, u.group_id, g.platform, request_id, model, j.status, decision, created_at, count(*) OVER () AS total FROM {_PLACED} WHERE g.platform = 'openai' AND model = 'model-2' AND j.status = 'done' AND created_at >= TIMESTAMP '1995-06-01' ORDER BY created_at DESC, j.id DESC LIMIT 20 OFFSET 20",
    ),
    (
        "h12_export_page",
        lambda t: export_page(t, JobFilter(decision="block", mode="async"), 200, 20),
        "SELECT p.*, count(*) OVER () = 200 AS has_more FROM (SELECT j.id::VARCHAR AS job_id, strftime(j.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, j.user_id::VARCHAR AS user_id, api_key_id::VARCHAR AS api_key_id, coalesce(g.platform, '') AS platform, protocol, run_mode AS mode, j.status, j.decision, CASE WHEN j.id % 2 = 0 THEN 'user' ELSE 'instruction' END AS trigger, request_id, "
        "coalesce(t.target_order::VARCHAR, '') AS target_order, coalesce(t.kind, '') AS target_kind, coalesce(t.resolution, '') AS resolution, coalesce(t.decision, '') AS target_decision, coalesce(printf('%.4f', r.score), '') AS score, CASE WHEN r.score >= 0.6 THEN 'over the limit' ELSE '' END AS reason, coalesce(strlen(x.text), 0)::VARCHAR AS bytes, CASE WHEN left(x.text, 1) IN ('=', '+', '-', '@') THEN '''' ELSE '' END || coalesce(x.text, '') AS text "
        f"FROM {_PLACED} LEFT JOIN targets t ON t.job_id = j.id AND t.round = j.current_round LEFT JOIN texts x ON x.hash_key = t.hash_key LEFT JOIN reviews r ON r.id = t.review_id WHERE j.decision = 'block' AND run_mode = 'async' ORDER BY j.id DESC, t.target_order NULLS LAST, t.hash_key NULLS FIRST, t.resolution NULLS FIRST, t.decision NULLS FIRST, t.review_id NULLS FIRST LIMIT 200 OFFSET 20) p",
    ),
    (
        "h14_config_impact",
        lambda t: config_impact(t, DRAFTS),
        f"SELECT * FROM (WITH forms AS ({_FORMS}) SELECT f.draft, concat_ws(',', CASE WHEN f.policy <> s.policy THEN 'policy' END, CASE WHEN f.nodes <> s.nodes THEN 'nodes' END) AS parts, {_HASH.format(k='user')} AS user_hash, {_HASH.format(k='instruction')} AS instruction_hash, (f.policy, f.nodes) <> (s.policy, s.nodes) AS user_changed, user_changed AS instruction_changed, "
        "(SELECT count(DISTINCT t.hash_key) FROM targets t JOIN jobs j ON j.id = t.job_id WHERE t.kind = 'instruction' AND j.created_at > TIMESTAMP '2001-01-01' AND t.hash_key NOT IN (SELECT hash_key FROM trust)) AS recent_blocks FROM forms f, forms s WHERE s.draft = 'same')",
    ),
    (
        "g10_claimable_jobs",
        claimable_jobs,
        "SELECT id, next_attempt_at, NOT ready AND NOT paused AS costs FROM (SELECT id, created_at + to_minutes(price % 600) AS next_attempt_at, run_mode, run_kind, price % 5 AS attempts, price % 4 = 0 AS paused, NOT EXISTS (SELECT 1 FROM targets t WHERE t.job_id = j.id AND t.round = j.current_round AND t.resolution IS NULL) OR EXISTS (SELECT 1 FROM targets t WHERE t.job_id = j.id AND t.round = j.current_round AND t.decision = 'block') AS ready FROM jobs j WHERE status = 'queued') "
        "WHERE next_attempt_at <= TIMESTAMP '1996-01-01' AND (ready OR (run_mode = 'async' OR run_kind = 'reaudit') AND (attempts < 3 OR paused)) ORDER BY next_attempt_at, id LIMIT 50",
    ),
    (
        "h17_event_board",
        event_board,
        "SELECT event, count(*) AS batches, count(DISTINCT user_id) AS subscriptions, count(*) FILTER (WHERE s = 'inflight') AS open, CASE WHEN bool_or(s = 'inflight') THEN 'pending' WHEN bool_or(s = 'uncertain') THEN 'uncertain' WHEN bool_or(s IN ('partial', 'failed')) THEN 'partial' ELSE 'completed' END AS status "
        "FROM (SELECT created_at::DATE AS event, user_id, CASE WHEN status = 'queued' THEN 'inflight' WHEN status = 'failed' THEN 'failed' WHEN decision = 'block' THEN 'uncertain' WHEN decision = 'review' THEN 'partial' ELSE 'succeeded' END AS s FROM jobs) GROUP BY event ORDER BY event DESC LIMIT 100",
    ),
    ("h19_valid_subscriptions", valid_subscriptions, f"SELECT s.id, s.user_id, s.group_id, g.name AS group_name, u.username, printf('%.2f', s.used) AS monthly_usage, s.starts_at + INTERVAL 12 MONTH AS expires_at {_VALID}"),
    ("h18_group_counts", group_counts, f"SELECT s.group_id, g.name AS group_name, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total {_VALID} GROUP BY 1, 2"),
]
