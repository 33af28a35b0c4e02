"""Every query by name, with the SQL that must give the same rows in DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlens.functions import conversation, decisions, protocol, text
from modlens.operators import relational
from modlens.plans import boards, bodies, clients, console, lifecycle, quota, stats, transitions
from modlens.sources import sinks
from modlens.sources.oracle import sql
from modlens.sources.tables import Tables
from modlens.streaming import admission, folds, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANGE = "created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01'"
CALLS = "dispatch_started_at >= TIMESTAMP '1995-01-01' AND dispatch_started_at < TIMESTAMP '1997-01-01'"


def query(name: str, make: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if oracle:
        ORACLES[name] = sql(oracle)


# --- sources, scalars -------------------------------------------------------------------------------------------------

query("a2_job_by_id", lambda t: t.jobs.where("id = 1000").select("id", "user_id", "status"), "SELECT id, user_id, status FROM jobs WHERE id = 1000")
query("a3_reviews_by_ids", lambda t: t.reviews.where(F.col("id").isin(1, 2, 3, 4, 500, 501)).select("id", "score"), "SELECT id, score FROM reviews WHERE id IN (1, 2, 3, 4, 500, 501)")
_PATHS = "CASE user_id % 9 WHEN 0 THEN '/v1/responses' WHEN 1 THEN '/v1/chat/completions' WHEN 2 THEN '/v1/messages' WHEN 3 THEN '/v1beta/models/x:generateContent' WHEN 4 THEN '/v1/embeddings' WHEN 5 THEN '/v1/images/edits' WHEN 6 THEN '/tts' WHEN 7 THEN '/v1/alpha/search' ELSE '/health' END"
query(
    "a15_protocols",
    lambda t: t.actions.select("id", F.expr(_PATHS).alias("path")).groupBy(protocol.protocol(F.col("path")).alias("protocol")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT CASE WHEN path LIKE '%/responses%' THEN 'responses' WHEN path LIKE '%/chat/completions' THEN 'chat_completions' WHEN path LIKE '%/messages%' THEN 'anthropic_messages' WHEN path LIKE '%/models/%' AND (path LIKE '%:generateContent%' OR path LIKE '%:streamGenerateContent%') THEN 'gemini' WHEN path LIKE '%/embeddings' THEN 'openai_embeddings' WHEN path LIKE '%/alpha/search' THEN 'openai_alpha_search' WHEN path LIKE '%/images/%' OR path LIKE '%/videos%' OR path IN ('/tts', '/stt') THEN 'media' ELSE 'unsupported' END AS protocol, count(*) AS n FROM (SELECT {_PATHS} AS path FROM actions) GROUP BY 1",
)
_AGENTS = "CASE user_id % 4 WHEN 0 THEN 'claude-cli/1.0' WHEN 1 THEN 'codex_cli_rs/0.1' WHEN 2 THEN 'GeminiCLI/0.2' ELSE 'curl/8' END"
query(
    "a16_clients",
    lambda t: t.actions.groupBy(protocol.client(F.expr(_AGENTS)).alias("client")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT CASE WHEN a LIKE 'claude-cli/%' THEN 'claude_code' WHEN a LIKE '%codex_cli_rs%' THEN 'codex' WHEN a LIKE 'GeminiCLI/%' THEN 'gemini_cli' ELSE 'generic' END AS client, count(*) AS n FROM (SELECT {_AGENTS} AS a FROM actions) GROUP BY 1",
)
query(
    "a17_export_rows",
    lambda t: sinks.export_rows(t.reviews.select("id", "created_at", "score", F.concat(F.lit("="), F.col("id").cast("string")).alias("note"))),
    "SELECT CAST(id AS varchar) AS id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, printf('%.4f', score) AS score, '''=' || id AS note FROM reviews",
)
query(
    "a18_csv_guard",
    lambda t: t.actions.select("id", text.csv_guard(F.expr("CASE id % 4 WHEN 0 THEN '=1' WHEN 1 THEN '-x' WHEN 2 THEN '@y' ELSE 'plain' END")).alias("cell")),
    "SELECT id, CASE WHEN left(c, 1) IN ('=', '+', '-', '@') THEN '''' || c ELSE c END AS cell FROM (SELECT id, CASE id % 4 WHEN 0 THEN '=1' WHEN 1 THEN '-x' WHEN 2 THEN '@y' ELSE 'plain' END AS c FROM actions)",
)
query("a19_json_rows", lambda t: sinks.json_rows(t.breakers), """SELECT '{"hash_key":' || hash_key || ',"status":"' || status || '","distinct_users":' || distinct_users || '}' AS row FROM breakers""")
query(
    "a20_metric_lines",
    lambda t: sinks.metric_lines(stats.by_status(t), "audit_jobs", ("status", "decision"), "n"),
    "SELECT 'audit_jobs{status=\"' || status || '\",decision=\"' || coalesce(decision, '') || '\"} ' || count(*) AS line FROM jobs GROUP BY status, coalesce(decision, '')",
)
query(
    "a21_insert_new",
    lambda t: relational.insert_new(t.trust.withColumn("origin", F.lit("old")), t.breakers.select("hash_key", F.lit("new").alias("origin")), "hash_key"),
    "SELECT hash_key, 'old' AS origin FROM trust UNION ALL SELECT DISTINCT hash_key, 'new' FROM breakers WHERE hash_key NOT IN (SELECT hash_key FROM trust)",
)
query(
    "a22_upsert",
    lambda t: relational.upsert(t.texts.select("hash_key", "size"), t.breakers.select("hash_key", F.lit(0).alias("size")), ["hash_key"]),
    "SELECT t.hash_key, CASE WHEN b.hash_key IS NULL THEN size ELSE 0 END AS size FROM texts t LEFT JOIN breakers b ON b.hash_key = t.hash_key",
)
query(
    "a23_zip_insert",
    lambda t: relational.zip_insert(t.trust.select(F.col("hash_key").alias("k"), F.array(F.lit("a"), F.lit("b")).alias("xs"), F.array("hash_key", F.col("hash_key") + 1).alias("ys")), kind="xs", n="ys"),
    "SELECT hash_key AS k, unnest(['a', 'b']) AS kind, unnest([hash_key, hash_key + 1]) AS n FROM trust",
)

# --- filters and projections --------------------------------------------------------------------------------------------

query("b1_job_list", boards.job_list, "SELECT j.id, j.user_id, coalesce(nullif(u.username, ''), '') AS username, decision, CAST(coalesce(epoch_us(finished_at - started_at) / 1000, 0) AS bigint) AS work_ms, j.user_id IN (SELECT user_id FROM actions WHERE execution_status IN ('pending', 'unknown')) AS action_pending FROM jobs j LEFT JOIN (SELECT * FROM users WHERE NOT deleted) u ON u.id = j.user_id WHERE run_mode = 'blocking' AND j.status = 'done' AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1996-01-01' ORDER BY created_at DESC, j.id DESC LIMIT 100 OFFSET 100")
query("b3_category_jobs", boards.category_jobs, "SELECT id, user_id, array_to_string(trigger_categories, ',') AS categories FROM jobs WHERE decision = 'block' AND list_has_any(trigger_categories, ['R02'])")
query("b5_action_list", boards.action_list, "SELECT id, user_id, execution_status, notification_status, requested_at, json_extract_string(business_snapshot, '$.k') AS k FROM actions WHERE execution_status IN ('failed', 'unknown') AND requested_at >= TIMESTAMP '2024-01-05' AND requested_at < TIMESTAMP '2024-01-20' ORDER BY id DESC LIMIT 50")
query("b8_trust_search", boards.trust_search, "SELECT t.hash_key, left(text, 500) AS preview FROM texts t JOIN trust USING (hash_key) WHERE CAST(t.hash_key AS varchar) LIKE '12%' OR text ILIKE '%12%'")
query("b13_monitor_candidates", quota.monitor_candidates, "SELECT id, concat_ws(',', CASE WHEN status <> 'active' THEN 'inactive' END, CASE WHEN deleted THEN 'deleted' END, CASE WHEN role <> 'user' THEN 'not_user' END, CASE WHEN balance < 0 THEN 'overdrawn' END) AS problems FROM users")
query("b19_reset_records", quota.reset_records, "SELECT u.id AS subscription_id, w AS \"window\", CAST(u.id * CASE w WHEN 'daily' THEN 2 WHEN 'weekly' THEN 3 ELSE 5 END AS varchar) AS usage FROM users u JOIN grps g ON g.id = group_id CROSS JOIN (SELECT unnest(['daily', 'weekly', 'monthly']) AS w) WHERE NOT deleted AND status = 'active' AND role = 'user' AND platform IN ('ASIA', 'EUROPE')")
query("b19_reset_records_keyword", lambda t: quota.reset_records(t, "00000001"), "SELECT u.id AS subscription_id, w AS \"window\", CAST(u.id * CASE w WHEN 'daily' THEN 2 WHEN 'weekly' THEN 3 ELSE 5 END AS varchar) AS usage FROM users u JOIN grps g ON g.id = group_id CROSS JOIN (SELECT unnest(['daily', 'weekly', 'monthly']) AS w) WHERE NOT deleted AND status = 'active' AND role = 'user' AND platform IN ('ASIA', 'EUROPE') AND (username ILIKE '%00000001%' OR CAST(u.id AS varchar) ILIKE '%00000001%')")

# --- joins ----------------------------------------------------------------------------------------------------------------

query("c2_job_prompts", boards.job_prompts, "SELECT job_id, target_order, kind, t.hash_key, resolution, coalesce(left(text, 10), '') AS preview, t.hash_key IN (SELECT hash_key FROM trust) AS trusted FROM targets t JOIN jobs j ON j.id = job_id AND round = current_round LEFT JOIN texts x ON x.hash_key = t.hash_key WHERE j.status = 'done'")
query("c4_export", boards.export, "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, user_id, run_mode, target_order, kind, resolution, score, text FROM (SELECT j.id, j.created_at, j.user_id, j.run_mode, t.target_order, t.kind, coalesce(t.resolution, '') AS resolution, CASE WHEN r.score IS NULL THEN '' ELSE printf('%.4f', r.score) END AS score, coalesce(x.text, '') AS text FROM jobs j LEFT JOIN targets t ON t.job_id = j.id AND t.round = j.current_round LEFT JOIN texts x ON x.hash_key = t.hash_key LEFT JOIN reviews r ON r.id = t.review_id WHERE j.decision = 'block' ORDER BY j.id DESC, t.target_order NULLS FIRST, t.kind NULLS FIRST, x.text NULLS FIRST, t.resolution NULLS FIRST LIMIT 1000)")
query("c9_reaudit_estimate", lifecycle.reaudit_estimate, "SELECT count(DISTINCT t.hash_key) AS estimated, count(DISTINCT job_id) AS jobs FROM targets t JOIN jobs j ON j.id = job_id AND round = current_round WHERE j.decision = 'block' AND t.hash_key NOT IN (SELECT hash_key FROM trust)")
query("c10_kept_texts", lifecycle.kept_texts, "SELECT hash_key, text FROM texts WHERE hash_key IN (SELECT hash_key FROM targets WHERE job_id IN (SELECT id FROM jobs WHERE created_at >= TIMESTAMP '1995-06-01' OR status = 'queued')) OR hash_key IN (SELECT hash_key FROM trust) OR hash_key IN (SELECT hash_key FROM breakers) OR hash_key IN (SELECT hash_key FROM (SELECT *, row_number() OVER (PARTITION BY hash_key, eval_key ORDER BY created_at DESC, id DESC) AS r FROM reviews WHERE id NOT IN (SELECT review_id FROM targets WHERE review_id IS NOT NULL AND job_id IN (SELECT id FROM jobs WHERE created_at >= TIMESTAMP '1995-06-01' OR status = 'queued'))) WHERE r <= 5 AND created_at >= TIMESTAMP '1995-06-01') OR hash_key IN (SELECT hash_key FROM reviews WHERE id IN (SELECT review_id FROM targets WHERE job_id IN (SELECT id FROM jobs WHERE created_at >= TIMESTAMP '1995-06-01' OR status = 'queued')))")
query("c12_similar_by_key", boards.similar_by_key, "SELECT a.hash_key AS a, b.hash_key AS b, CAST(bit_count(xor(a.s, b.s)) AS integer) AS distance FROM (SELECT hash_key, hash_key * hash_key * 7919 + size * 64 AS s FROM texts) a JOIN (SELECT hash_key, hash_key * hash_key * 7919 + size * 64 AS s FROM texts) b ON a.hash_key < b.hash_key AND bit_count(xor(a.s, b.s)) <= 3")
query("c12_similar_prompts", boards.similar_prompts)
query("h10_similar_pair", boards.similar_pair)
query("c14_reused_reviews", lifecycle.reused_reviews, "SELECT j.id AS job_id, r.id AS review_id, r.score AS review_score FROM jobs j LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY hash_key, eval_key ORDER BY created_at DESC, id DESC) AS n FROM reviews WHERE reusable) r ON r.n = 1 AND r.hash_key = j.id % 400 AND r.eval_key = j.id % 3 AND r.created_at >= j.created_at - INTERVAL 365 DAY WHERE decision = 'block'")
query("c23_requalified", quota.requalified, "SELECT f.id AS item, CASE WHEN s.id IS NULL THEN 'gone' WHEN (f.group_id + CASE WHEN f.id % 10 = 0 THEN 1 ELSE 0 END) % 25 <> s.group_id THEN 'moved' ELSE 'valid' END AS state FROM users f LEFT JOIN (SELECT u.* FROM users u JOIN grps g ON g.id = group_id WHERE NOT deleted AND status = 'active' AND role = 'user' AND platform IN ('ASIA', 'EUROPE')) s ON s.id = f.id WHERE f.role = 'user'")

# --- aggregates --------------------------------------------------------------------------------------------------------------

_HEAD = "SELECT count(*) AS jobs, count(*) FILTER (WHERE orphan_continuation) AS orphans, count(*) FILTER (WHERE run_kind = 'reaudit') AS reaudits, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE decision = 'pass') AS pass, count(*) FILTER (WHERE decision = 'review') AS review, count(*) FILTER (WHERE decision = 'block') AS block FROM jobs WHERE " + RANGE
query("d1_headline", stats.headline, _HEAD)
query("d1_headline_blocking", lambda t: stats.headline(t, "blocking"), _HEAD + " AND run_mode = 'blocking'")
query("d2_backlog", stats.backlog, "SELECT count(*) AS waiting, min(created_at) AS since FROM jobs WHERE status IN ('queued', 'retry')")
query("d3_action_stock", stats.action_stock, "SELECT execution_status, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM actions WHERE execution_status IN ('pending', 'processing', 'unknown') OR notification_status IN ('pending', 'processing', 'retry') GROUP BY 1")
query("d4_blocking_waits", stats.blocking_waits, f"SELECT count(*) AS n, avg(blocking_wait_ms) AS mean, max(blocking_wait_ms) AS most, quantile_cont(blocking_wait_ms, 0.5) AS p50, quantile_cont(blocking_wait_ms, 0.95) AS p95 FROM jobs WHERE run_mode = 'blocking' AND blocking_wait_ms IS NOT NULL AND {RANGE}")
query("d5_durations", stats.durations, "SELECT " + ", ".join(f"quantile_cont(epoch_us({a} - {b}) / 1000, {p}) AS {k}_p{int(p * 100)}" for k, (a, b) in {"whole": ("finished_at", "created_at"), "queue": ("started_at", "created_at"), "work": ("finished_at", "started_at")}.items() for p in (0.5, 0.95)) + f" FROM jobs WHERE {RANGE}")
query("d6_cache_misses", stats.cache_misses, f"SELECT client_fingerprint, kind, count(*) AS targets, count(*) FILTER (WHERE resolution = 'model') AS calls, count(*) FILTER (WHERE resolution = 'model') / count(*) AS miss_rate FROM targets JOIN jobs ON id = job_id WHERE {RANGE} GROUP BY 1, 2")
query("d7_template_churn", stats.template_churn, "SELECT client_fingerprint, count(DISTINCT hash_key) AS hashes, count(DISTINCT job_id) AS jobs, count(DISTINCT hash_key) / count(DISTINCT job_id) AS churn FROM targets JOIN jobs ON id = job_id WHERE kind = 'instruction' AND created_at >= TIMESTAMP '1997-01-01' - INTERVAL 7 DAY AND created_at < TIMESTAMP '1997-01-01' GROUP BY 1")
query("d8_category_counts", stats.category_counts, f"SELECT coalesce(c, '') AS category, count(*) AS n FROM (SELECT unnest(CASE WHEN trigger_categories IS NULL OR len(trigger_categories) = 0 THEN [NULL] ELSE trigger_categories END) AS c FROM jobs WHERE decision = 'block' AND {RANGE}) GROUP BY 1")
query("d9_recognition", stats.recognition, f"SELECT model_id, count(*) AS total, count(*) FILTER (WHERE line % 3 < 2) AS recognised, count(*) FILTER (WHERE line % 3 < 2) / count(*) AS rate FROM attempts a JOIN jobs j ON j.id = job_id WHERE call_kind = 'audit' AND a.status = 'succeeded' AND j.decision IN ('block', 'review') AND {RANGE} GROUP BY 1")
query("d12_costs", boards.costs, f"SELECT date_trunc('month', dispatch_started_at + INTERVAL 8 HOUR)::TIMESTAMP AS bucket, a.model_id, call_kind, stage, count(*) AS calls, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, count(*) FILTER (WHERE status = 'succeeded' AND (input_tokens IS NULL OR output_tokens IS NULL)) AS unknown_usage, quantile_cont(latency_ms, 0.5) AS p50_ms, coalesce(max(name), 'snapshot') AS node FROM attempts a LEFT JOIN nodes n ON n.model_id = a.model_id WHERE {CALLS} GROUP BY 1, 2, 3, 4")
query("d13_reuse", boards.reuse, f"SELECT kind, resolution, count(*) AS targets FROM targets JOIN jobs ON id = job_id WHERE resolution IS NOT NULL AND {RANGE} GROUP BY 1, 2")
query("d14_cost_summary", boards.cost_summary, f"SELECT model_id, count(*) FILTER (WHERE call_kind = 'audit' AND stage <> 'format_repair') AS audit, count(*) FILTER (WHERE call_kind = 'audit' AND stage = 'format_repair') AS repair, count(*) FILTER (WHERE call_kind <> 'audit') AS probe, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS tokens, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT / sum(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))) OVER ()::BIGINT AS share FROM attempts WHERE {CALLS} GROUP BY 1")
query("d15_inbox", boards.inbox, "SELECT * FROM (SELECT 'action_failed' AS category, count(*) AS n FROM actions WHERE execution_status IN ('failed', 'unknown') UNION ALL SELECT 'notification_failed', count(*) FROM actions WHERE notification_status = 'failed' AND requested_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY UNION ALL SELECT 'breaker_pending', count(*) FROM breakers WHERE status = 'tripped' UNION ALL SELECT 'total', (SELECT count(*) FROM actions WHERE execution_status IN ('failed', 'unknown')) + (SELECT count(*) FROM actions WHERE notification_status = 'failed' AND requested_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) + (SELECT count(*) FROM breakers WHERE status = 'tripped'))")
query("d16_failure_alert", stats.failure_alert, "SELECT date_trunc('hour', requested_at)::TIMESTAMP AS hour, count(*) AS jobs, count(*) FILTER (WHERE execution_status = 'failed') AS failed, count(*) FILTER (WHERE execution_status = 'failed') / count(*) AS rate, count(*) >= 20 AND count(*) FILTER (WHERE execution_status = 'failed') / count(*) >= 0.2 AS alert FROM actions GROUP BY 1")
query("d17_hourly", stats.hourly, "SELECT date_trunc('hour', requested_at)::TIMESTAMP AS hour, count(*) AS jobs, count(*) FILTER (WHERE execution_status = 'failed') AS failed, count(*) FILTER (WHERE notification_status = 'failed') AS unsent, round(avg(value), 6) AS mean_value FROM actions GROUP BY 1")
query("d19_config_impact", lifecycle.config_impact, "SELECT count(DISTINCT hash_key) AS targets FROM targets WHERE decision = 'block' AND job_id IN (SELECT id FROM jobs WHERE created_at >= TIMESTAMP '1997-01-01' - INTERVAL 30 DAY AND created_at < TIMESTAMP '1997-01-01') AND hash_key NOT IN (SELECT hash_key FROM trust)")
_SUBS = "users u JOIN grps g ON g.id = group_id WHERE NOT deleted AND status = 'active' AND role = 'user' AND platform IN ('ASIA', 'EUROPE')"
query("d20_subscriptions_by_group", quota.by_group, f"SELECT group_id, platform, count(*) AS n FROM {_SUBS} GROUP BY 1, 2")
query("d21_breaker_list", boards.breaker_list, "SELECT b.hash_key, b.status, b.distinct_users, left(text, 500) AS preview, coalesce(array_to_string(us, ','), '') AS users, b.hash_key IN (SELECT hash_key FROM trust) AS trusted FROM breakers b LEFT JOIN texts x ON x.hash_key = b.hash_key LEFT JOIN (SELECT hash_key, list_slice(list_sort(list(DISTINCT user_id)), 1, 20) AS us FROM targets JOIN jobs ON id = job_id WHERE kind = 'instruction' GROUP BY 1) u ON u.hash_key = b.hash_key")
query("d22_key_values", boards.key_values, "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM actions GROUP BY 1")
query("d23_by_status", stats.by_status, "SELECT status, coalesce(decision, '') AS decision, count(*) AS n FROM jobs GROUP BY 1, 2")
query("d24_latest_latency", boards.latest_latency, "SELECT model_id, max(n) AS n, min(latency_ms) FILTER (WHERE r >= ceil(n * 0.5)) AS p50, min(latency_ms) FILTER (WHERE r >= ceil(n * 0.95)) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY model_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY dispatch_started_at DESC, job_id DESC, line DESC, latency_ms DESC) AS k FROM attempts) WHERE k <= 1000) GROUP BY 1")
query("d26_legacy_groups", quota.legacy_groups, f"SELECT DISTINCT platform, group_id FROM {_SUBS}")
query("d30_replay_groups", boards.replay_groups, "SELECT CASE WHEN actual = expected THEN 'consistent' WHEN actual = 'review' THEN 'review' WHEN expected = 'pass' THEN 'misjudged' ELSE 'missed' END AS outcome, count(*) AS n FROM samples GROUP BY 1")

# --- windows and order -------------------------------------------------------------------------------------------------------

query("e1_kept_reviews", lifecycle.kept_reviews, "SELECT id, hash_key, eval_key FROM reviews WHERE id IN (SELECT review_id FROM targets WHERE job_id IN (SELECT id FROM jobs WHERE created_at >= TIMESTAMP '1995-06-01' OR status = 'queued')) UNION ALL SELECT id, hash_key, eval_key FROM (SELECT *, row_number() OVER (PARTITION BY hash_key, eval_key ORDER BY created_at DESC, id DESC) AS r FROM reviews WHERE id NOT IN (SELECT review_id FROM targets WHERE review_id IS NOT NULL AND job_id IN (SELECT id FROM jobs WHERE created_at >= TIMESTAMP '1995-06-01' OR status = 'queued'))) WHERE r <= 5 AND created_at >= TIMESTAMP '1995-06-01'")
query("e2_top_targets", boards.top_targets, "SELECT user_id, id, price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY price DESC, id) AS r FROM jobs) WHERE r <= 2")
query("e3_warning_window", boards.warning_window, "SELECT id, user_id, sum(violation_counted::BIGINT) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS violations FROM jobs WHERE status = 'done' AND enforcement_eligible")
query("e8_recent_failures", boards.recent_failures, "SELECT id, user_id, execution_status, requested_at, json_extract_string(business_snapshot, '$.k') AS k FROM actions WHERE execution_status IN ('failed', 'unknown') ORDER BY id DESC LIMIT 5")
query("e9_last_points", boards.last_points, "SELECT hour, n, row_number() OVER (ORDER BY hour) AS place, row_number() OVER (ORDER BY hour) IN (1, 25, 48) AS labelled FROM (SELECT date_trunc('hour', requested_at)::TIMESTAMP AS hour, count(*) AS n FROM actions GROUP BY 1 ORDER BY 1 DESC LIMIT 48)")
query("e12_reaudit_plan", lifecycle.reaudit_plan, "SELECT id, CASE WHEN status NOT IN ('done', 'failed', 'skipped') THEN 'already_running' WHEN r > 200 THEN 'skipped' ELSE 'requeued' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY status IN ('done', 'failed', 'skipped') ORDER BY id) AS r FROM jobs WHERE decision = 'block' OR status = 'queued')")

# --- texts, votes, conversations ------------------------------------------------------------------------------------------------

query("f2_text_hashes", boards.text_hashes, "SELECT sha256(kind || chr(0) || t) AS hash, min(id) AS first_id, count(*) AS n FROM (SELECT id, kind, regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS t FROM prompts) GROUP BY 1")
query("f3_simhash", lambda t: t.prompts.select("id", text.simhash64("text").alias("simhash")))
query(
    "f8_target_categories",
    lifecycle.target_categories,
    "SELECT j.id, j.decision, coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (j.decision <> 'pass' AND a.status <> 'failed' AND a.confidence >= CASE j.decision WHEN 'block' THEN 0.05 ELSE 0.02 END AND c <= 'R07'), '') AS codes "
    "FROM jobs j JOIN (SELECT *, unnest(CASE line % 3 WHEN 0 THEN ['R0' || (1 + model_id % 9)] WHEN 1 THEN ['R01', 'R0' || (1 + hash_key % 9)] ELSE ['none'] END) AS c FROM attempts WHERE call_kind = 'audit') a ON a.job_id = j.id WHERE j.decision IS NOT NULL GROUP BY 1, 2",
)
_VOTES = "SELECT job_id, hash_key, count(*) FILTER (WHERE NOT f AND NOT s AND v = 'block') AS b, count(*) FILTER (WHERE NOT f AND NOT s AND v = 'review') AS r, count(*) FILTER (WHERE f) AS x, count(*) FILTER (WHERE s) AS k, count(*) AS n, max(CASE WHEN NOT f AND NOT s THEN confidence END) AS score FROM (SELECT *, status = 'failed' AS f, line = 5 AND status <> 'failed' AS s, CASE WHEN confidence * 10 >= 6.0 THEN 'block' WHEN confidence * 10 >= 3.0 THEN 'review' ELSE 'pass' END AS v FROM attempts) GROUP BY 1, 2"
for _rule, _need in (("majority_block", "n // 2 + 1"), ("all_block", "n"), ("any_block", "1")):
    query(
        f"f12_votes_{_rule}",
        lambda t, rule=_rule: lifecycle.votes(t, rule),
        f"SELECT job_id, hash_key, CASE WHEN b >= {_need} THEN 'block' WHEN k > 0 OR b + x >= {_need} THEN NULL WHEN b + r + x > 0 THEN 'review' ELSE 'pass' END AS decision, x > 0 AS partial, CASE WHEN b >= {_need} THEN NULL WHEN k > 0 THEN 'invalid_model_result' WHEN b + x >= {_need} THEN 'audit_unavailable' END AS failure, score FROM ({_VOTES})",
    )
query("f14_job_decisions", lifecycle.job_decisions, "SELECT job_id, CASE WHEN o = 0 OR d = 'block' THEN d END AS decision, CASE WHEN o = 0 OR d = 'block' THEN kind END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE d WHEN 'block' THEN 3 WHEN 'review' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END DESC, kind = 'user' DESC, target_order) AS r, count(*) FILTER (WHERE d IS NULL) OVER (PARTITION BY job_id) AS o FROM (SELECT job_id, target_order, min(kind) AS kind, max(decision) AS d FROM targets GROUP BY 1, 2)) WHERE r = 1")
_CURRENT = r"""SELECT * FROM (WITH said AS (
  SELECT * FROM (SELECT conv_id, turn, CASE WHEN role IN ('system', 'developer') THEN 'instruction' ELSE role END AS role, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM turns) WHERE text <> ''
), told AS (
  SELECT conv_id, list(h ORDER BY t) AS hashes FROM (SELECT conv_id, sha256('instruction' || chr(0) || text) AS h, min(turn) AS t FROM said WHERE role = 'instruction' GROUP BY ALL) GROUP BY conv_id
), talk AS (
  SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS fin FROM (SELECT *, max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM said WHERE role <> 'instruction') WHERE turn <= last
), run AS (
  SELECT conv_id, bool_or(turn = last AND role = 'tool') AS continuation, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user' AND turn > stop AND turn <= fin) AS asked FROM (SELECT *, coalesce(max(CASE WHEN role <> 'user' AND turn < fin THEN turn END) OVER (PARTITION BY conv_id), -1) AS stop FROM talk) GROUP BY conv_id
) SELECT conv_id, coalesce(continuation, false) AS continuation, CASE WHEN coalesce(asked, '') <> '' THEN sha256('user' || chr(0) || asked) ELSE '' END AS user_hash, coalesce(len(hashes), 0)::BIGINT AS instructions,
  sha256('{"instructions":[' || coalesce(array_to_string(list_transform(hashes, lambda x: '"' || x || '"'), ','), '') || '],"user":"' || user_hash || '"}') AS fingerprint
FROM (SELECT DISTINCT conv_id FROM said) LEFT JOIN run USING (conv_id) LEFT JOIN told USING (conv_id))"""
query("f18_turns", lambda t: conversation.turns(t.turns), _CURRENT)
query(
    "f28_delays",
    lambda t: t.actions.select("id", decisions.auto_retry_minutes(F.col("user_id") % 4).alias("minutes"), decisions.cooldown_s(1 + F.col("user_id") % 8).alias("cooldown"), decisions.notification_delay_s(F.col("user_id") % 12).alias("notify")),
    "SELECT id, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 15 END AS minutes, CAST(least(15 * pow(2, user_id % 8), 300) AS bigint) AS cooldown, CAST(pow(2, least(user_id % 12, 8)) AS bigint) AS notify FROM actions",
)
query("f31_zone_buckets", lambda t: t.actions.groupBy(F.date_trunc("day", F.from_utc_timestamp(F.col("requested_at").cast("timestamp"), "Asia/Shanghai")).cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n")), "SELECT date_trunc('day', requested_at + INTERVAL 8 HOUR)::TIMESTAMP AS day, count(*) AS n FROM actions GROUP BY 1")

# --- state and lifecycle -----------------------------------------------------------------------------------------------------------


def _enforced(t: Tables) -> DataFrame:
    users = t.users.select(F.col("id").alias("uid"), "role", F.col("status").alias("user_status"))
    jobs = t.jobs.where("status = 'done'").join(users, F.col("user_id") == F.col("uid"))
    rows = jobs.select("id", "user_id", F.col("enforcement_eligible").alias("eligible"), F.col("violation_counted").alias("violation"), "run_mode", "role", "user_status", F.expr("CASE WHEN category_code = 'R09' THEN 'notice_only' WHEN category_code = 'R08' THEN 'immediate_disable' ELSE '' END").alias("disposition"))
    return folds.run_batch(rows, "user_id", ["id"], folds.moving(folds.enforce, limit=1, window=5, disable_limit=2), "user_id long, job_id long, action string, counted long")


def _breakers(t: Tables) -> DataFrame:
    marks = t.targets.where("kind = 'instruction' AND decision = 'block'").join(t.jobs.select("id", "user_id"), F.col("job_id") == F.col("id"))
    rows = marks.select("hash_key", "user_id", "job_id").distinct()
    # without trust and untrust events between the marks, the fold is a running count of first marks
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("hash_key", "user_id").orderBy("job_id")))
    so_far = Window.partitionBy("hash_key").orderBy("job_id", "user_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("users", F.sum((F.col("seen") == 1).cast("long")).over(so_far))
    outcome = F.when(F.col("seen") > 1, "repeated").when(F.col("users") >= 2, "suppressed").otherwise("countable")
    return rows.select("hash_key", "user_id", "job_id", outcome.alias("outcome"), F.when(F.col("users") >= 2, "tripped").otherwise("").alias("status"), "users")


def _flights(t: Tables) -> DataFrame:
    jobs = t.jobs.select("id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"), "price", "run_kind")
    rows = t.targets.where("resolution IS NULL OR resolution = 'model'").select("job_id", "target_order", "hash_key").join(jobs, F.col("job_id") == F.col("id"))
    at = F.col("created") + F.col("target_order") * 1_000_000
    rows = rows.select("id", F.col("target_order").alias("place"), at.alias("at"), (F.col("created") + (1 + F.col("price") % 900) * F.lit(86_400_000_000)).alias("ends"), F.when(F.col("run_kind") == "reaudit", F.col("created")).alias("reuse_after"), F.concat_ws(":", "hash_key", F.col("price") % 3).alias("key"))
    return folds.run_batch(rows, "key", ["at", "id", "place"], folds.join_flights, "job_id long, target_order long, scored_by long, inflight boolean")


_FLIGHTS = """
SELECT id AS job_id, place AS target_order, leader AS scored_by, joins AS inflight FROM (
WITH RECURSIVE log AS (
  SELECT j.id, t.target_order AS place, epoch_us(j.created_at) + t.target_order * 1000000 AS tm, epoch_us(j.created_at) + (1 + j.price % 900) * 86400000000 AS over_, CASE WHEN j.run_kind = 'reaudit' THEN epoch_us(j.created_at) END AS since, t.hash_key || ':' || (j.price % 3) AS key, row_number() OVER (PARTITION BY t.hash_key, j.price % 3 ORDER BY tm, j.id, t.target_order) AS n
  FROM targets t JOIN jobs j ON j.id = t.job_id WHERE t.resolution IS NULL OR t.resolution = 'model'
), run AS (
  SELECT DISTINCT key, 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS place, NULL::BIGINT AS leader, NULL::BIGINT AS started, [0::BIGINT][1:0] AS ends, false AS joins FROM log
  UNION ALL
  SELECT key, n, id, place, CASE WHEN joins THEN leader ELSE id END, CASE WHEN joins THEN started ELSE tm END, CASE WHEN joins THEN left_ ELSE list_append(left_, over_) END, joins
  FROM (SELECT *, leader IS NOT NULL AND len(left_) = len(ends) AND (since IS NULL OR started >= since) AS joins FROM (SELECT l.*, r.leader, r.started, r.ends, list_filter(r.ends, lambda e: e > l.tm) AS left_ FROM run r JOIN log l ON l.key = r.key AND l.n = r.n + 1))
) SELECT * FROM run WHERE n > 0)
"""


def _operated(t: Tables) -> DataFrame:
    """Marks of violations between what operators do to a hash: trust, untrust and confirm, by the actions of the hash in their data."""
    start, month = (F.unix_micros(F.lit(x).cast("timestamp")) for x in ("1995-01-01", "2024-01-01"))
    marks = t.targets.where("kind = 'instruction' AND decision = 'block'").join(t.jobs.select("id", "user_id", "created_at"), F.col("job_id") == F.col("id"))
    marks = marks.select(F.col("hash_key") % 100, "user_id", "job_id", F.unix_micros(F.col("created_at").cast("timestamp")), F.lit("")).distinct()
    event = F.when(F.col("event_type") == "signup", "trust").when(F.col("event_type") == "purchase", "untrust").when(F.col("event_type") == "view", "confirm")
    moved = start + (F.unix_micros(F.col("requested_at").cast("timestamp")) - month) * 80
    acts = t.actions.where("event_type IN ('signup', 'purchase', 'view')").select(F.get_json_object("business_snapshot", "$.k").cast("long"), F.lit(None).cast("long"), "id", moved, event)
    return operated_breakers(marks.toDF(*MARKS).unionByName(acts.toDF(*MARKS)))


MARKS = ("hash_key", "user_id", "job_id", "at", "event")


def operated_breakers(marks: DataFrame, users_to_trip: int = 2) -> DataFrame:
    """folds.break_circuit() as windows: what operators do (event is not '') cuts a hash's marks into segments, and within one the state only changes when it
    trips: at the first new user's mark with enough users. Order: (at, event first, job_id, user_id)."""
    order = ["at", F.col("event") == "", "job_id", "user_id"]
    so_far = Window.partitionBy("hash_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("event") == ""
    first = F.row_number().over(Window.partitionBy("hash_key", "event", "user_id").orderBy(*order)) == 1
    rows = marks.withColumn("new", mark & first)
    rows = rows.withColumns({"users": F.sum(F.col("new").cast("long")).over(so_far), "segment": F.sum((~mark).cast("long")).over(so_far), "act": F.last(F.when(~mark, F.col("event")), True).over(so_far)})
    trips = F.col("new") & (F.col("users") >= users_to_trip)
    within = Window.partitionBy("hash_key", "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tripped", F.max(trips).over(within)).where(mark)
    status = F.when(F.col("act") == "trust", "trusted").when(F.col("act") == "confirm", "confirmed").when(F.col("tripped"), "tripped").otherwise("")
    rows = rows.withColumn("status", status)
    outcome = F.when(~F.col("new"), "repeated").when(F.col("status").isin("tripped", "trusted"), "suppressed").otherwise("countable")
    return rows.select("hash_key", "user_id", "job_id", outcome.alias("outcome"), "status", "users")


#: The same by a walk: each mark or act takes its hash's users and state one step on.
_OPERATED = """
SELECT hash_key, user_id, job_id, CASE WHEN old THEN 'repeated' WHEN status IN ('tripped', 'trusted') THEN 'suppressed' ELSE 'countable' END AS outcome, status, len(users) AS users FROM (
WITH RECURSIVE log AS (
  SELECT *, row_number() OVER (PARTITION BY hash_key ORDER BY tm, event = '', job_id, user_id) AS n FROM (
    SELECT DISTINCT hash_key % 100 AS hash_key, user_id, job_id, epoch_us(created_at) AS tm, '' AS event FROM targets t JOIN jobs j ON j.id = t.job_id WHERE kind = 'instruction' AND t.decision = 'block'
    UNION ALL SELECT json_extract_string(business_snapshot, '$.k')::BIGINT, NULL, id, epoch_us(TIMESTAMP '1995-01-01') + (epoch_us(requested_at) - epoch_us(TIMESTAMP '2024-01-01')) * 80, CASE event_type WHEN 'signup' THEN 'trusted' WHEN 'view' THEN 'confirmed' ELSE 'none' END FROM actions WHERE event_type IN ('signup', 'purchase', 'view'))
), run AS (
  SELECT DISTINCT hash_key, 0::BIGINT AS n, NULL::BIGINT AS user_id, NULL::BIGINT AS job_id, '' AS event, false AS old, '' AS status, [0::BIGINT][1:0] AS users FROM log
  UNION ALL
  SELECT l.hash_key, l.n, l.user_id, l.job_id, l.event, list_contains(r.users, l.user_id), CASE WHEN l.event = 'none' THEN '' WHEN l.event <> '' THEN l.event WHEN r.status = '' AND NOT list_contains(r.users, l.user_id) AND len(r.users) >= 1 THEN 'tripped' ELSE r.status END,
    CASE WHEN l.event <> '' OR list_contains(r.users, l.user_id) THEN r.users ELSE list_append(r.users, l.user_id) END
  FROM run r JOIN log l ON l.hash_key = r.hash_key AND l.n = r.n + 1
) SELECT * FROM run WHERE n > 0 AND event = '')
"""


def _throttled(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("requested_at").cast("timestamp"))
    # gaps are taken between rounded seconds, half to even, as SQL's cast makes them; the order goes by whole seconds begun
    rows = t.actions.where("event_type = 'error'").select("id", "user_id", F.rint(us / 1e6).cast("long").alias("at_s"), F.floor(us / 1e6).alias("begun_s"))
    return folds.run_batch(rows, "user_id", ["begun_s", "id"], folds.throttle, "user_id long, id long, sent boolean, held_back long")


def _health(t: Tables, made: str = "model_id long, at_s long, health string, cooldown_until double, latency_ewma double") -> DataFrame:
    error = F.when(F.col("status") == "succeeded", "").when(F.col("line") == 2, "rate_limited").otherwise("timeout")
    rows = t.attempts.select("model_id", F.unix_timestamp(F.col("dispatch_started_at").cast("timestamp")).alias("at_s"), "latency_ms", error.alias("error"), F.lit(True).alias("retryable"), F.lit(0).alias("retry_after_s"), "job_id", "line")
    return folds.run_batch(rows, "model_id", ["at_s", "job_id", "line", "latency_ms"], folds.node_health, made)


def _resets(t: Tables) -> DataFrame:
    at = F.unix_timestamp(F.col("requested_at").cast("timestamp"))
    week = F.lit(folds.WEEK_S)
    edge = F.floor(at / week) * week + week + F.col("user_id") * 60
    rows = t.actions.select(F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("epoch"), at.alias("now_s"), at.alias("fetched_s"), F.when(F.col("event_type") == "signup", 0).otherwise(edge).cast("long").alias("reset_s"), F.abs("value").alias("used"), F.lit("a").alias("upstream"), "id")
    return folds.run_batch(rows, "epoch", ["now_s", "id"], folds.moving(folds.detect_reset, advance_s=6 * 86400), "epoch string, fetched_s long, rule string, event_key string, reset_at_s double, baseline_s double")


query("g1_sessions", lambda t: streams.user_sessions(t.raw("events")).select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n"), "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def _with_back(t: Tables) -> DataFrame:
    """The events with `back`, the id of the same user's event before, or the one three before that."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # dealt by number, so that the fold, which keeps this deal, isn't left with as few tasks as there are cores
    events = t.raw("events").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    return events.withColumn("back", F.when(F.col("event_id") % 2 == 0, F.lag("event_id", 1).over(w)).otherwise(F.lag("event_id", 4).over(w)))


#: Each row of the log takes its user's tables one step on; maps hold what was entered and when it was used last.
_ADMISSION = """
SELECT user_id, id, kind, job_id, error, turn FROM (
WITH RECURSIVE events1 AS (
  SELECT *, CASE WHEN event_id % 2 = 0 THEN lag(event_id, 1) OVER w ELSE lag(event_id, 4) OVER w END AS back, epoch_us(ts) AS us, floor(value * 100)::BIGINT AS cents, user_id || ':f' || (json_extract_string(props, '$.k')::BIGINT % 3) AS turn
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), log AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, tag, id) AS n FROM (
    SELECT user_id, us AS tm, 0 AS tag, event_id AS id, turn, event_type IN ('click', 'error') AS goes_on, CASE WHEN event_type = 'click' THEN 'r' || back END AS previous, value < 20 AS blocking, NULL AS status, NULL AS decision FROM events1
    UNION ALL SELECT user_id, us + CASE WHEN cents % 7 = 0 THEN 86400000000 ELSE cents * 100000 END, 1, event_id, turn, false, NULL, false, CASE WHEN cents % 11 = 0 THEN 'failed' ELSE 'done' END, CASE WHEN cents % 11 = 0 THEN '' WHEN cents % 10 = 0 THEN 'block' WHEN cents % 10 < 3 THEN 'review' ELSE 'pass' END FROM events1
    UNION ALL SELECT user_id, us + 30000000, 2, event_id, turn, false, NULL, false, NULL, NULL FROM events1 WHERE event_type <> 'view')
), run AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, MAP([], [])::MAP(VARCHAR, STRUCT(job BIGINT, status VARCHAR, decision VARCHAR, tm BIGINT)) AS turns, MAP([], [])::MAP(VARCHAR, STRUCT(turn VARCHAR, tm BIGINT)) AS replies, MAP([], [])::MAP(BIGINT, BIGINT) AS jobs,
    NULL::BIGINT AS id, NULL::VARCHAR AS kind, NULL::BIGINT AS job_id, NULL::VARCHAR AS error, NULL::VARCHAR AS turn FROM log
  UNION ALL
  SELECT user_id, n,
    CASE WHEN tag = 0 AND hit IS NULL THEN map_concat(turns, MAP([turn], [{'job': id, 'status': 'queued', 'decision': '', 'tm': tm}])) WHEN tag = 0 THEN map_concat(turns, MAP([found], [{'job': hit.job, 'status': hit.status, 'decision': hit.decision, 'tm': tm}]))
      WHEN tag = 1 AND tm - jobs[id] < 43200000000 THEN map_concat(turns, MAP([turn], [{'job': id, 'status': status, 'decision': decision, 'tm': tm}])) ELSE turns END,
    CASE WHEN tag = 2 THEN map_concat(replies, MAP(['r' || id], [{'turn': turn, 'tm': tm}])) WHEN told IS NOT NULL THEN map_concat(replies, MAP([previous], [{'turn': told, 'tm': tm}])) ELSE replies END,
    CASE WHEN tag = 0 AND hit IS NULL THEN map_concat(jobs, MAP([id], [tm])) ELSE jobs END,
    CASE WHEN tag = 0 THEN id END,
    CASE WHEN hit IS NULL THEN 'new' WHEN hit.status = 'done' AND hit.decision = 'block' THEN 'block' WHEN hit.status = 'done' AND hit.decision = 'review' THEN 'flag' WHEN hit.status = 'done' OR NOT blocking THEN 'allow' ELSE 'wait' END,
    CASE WHEN hit IS NULL THEN id ELSE hit.job END, CASE WHEN hit.status = 'done' AND hit.decision = 'block' THEN 'third_party_audit_blocked' END, coalesce(found, turn)
  FROM (SELECT *, CASE WHEN tag = 0 THEN CASE WHEN goes_on AND tm - turns[bound].tm < 43200000000 THEN bound WHEN tm - turns[turn].tm < 43200000000 THEN turn END END AS found, turns[found] AS hit
    FROM (SELECT *, CASE WHEN tag = 0 AND goes_on AND previous IS NOT NULL AND tm - replies[previous].tm < 43200000000 THEN replies[previous].turn END AS told, coalesce(told, turn) AS bound
      FROM (SELECT l.*, r.turns, r.replies, r.jobs FROM run r JOIN log l ON l.user_id = r.user_id AND l.n = r.n + 1)))
) SELECT * FROM run WHERE id IS NOT NULL)
"""


query("g2_admission", lambda t: admission.admitted(admission.event_log(_with_back(t)), ttl=12 * 3_600_000_000), _ADMISSION)
def _history(t: Tables) -> DataFrame:
    """A user's jobs, later rounds and account actions in one log. The events of a month stand for actions over the jobs' years."""
    users = t.users.select(F.col("id").alias("uid"), "role", F.col("status").alias("user_status"))
    done = t.jobs.where("status = 'done'").join(users, F.col("user_id") == F.col("uid"))
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    level = F.expr("CASE WHEN category_code = 'R09' THEN 'notice_only' WHEN category_code = 'R08' THEN 'immediate_disable' ELSE '' END")
    jobs = done.select("user_id", at.alias("at"), F.lit(folds.JOB).alias("tag"), "id", F.lit(True).alias("ok"), F.col("enforcement_eligible").alias("eligible"), F.col("violation_counted").alias("violation"), "run_mode", "role", "user_status", level.alias("disposition"), at.alias("created"), "price")
    rounds = jobs.where("violation AND price % 3 = 0").withColumns({"tag": F.lit(folds.REAUDIT), "at": F.col("at") + F.when(F.col("price") % 2 == 0, 40).otherwise(400) * F.lit(86_400_000_000)})
    start, month = (F.unix_micros(F.lit(x).cast("timestamp")) for x in ("1995-01-01", "2024-01-01"))
    kind = F.when(F.col("event_type") == "signup", folds.RESET).when(F.col("event_type") == "purchase", folds.RESET_DONE).when(F.col("event_type").isin("click", "error"), folds.SENT)
    none = {"eligible": "boolean", "violation": "boolean", "run_mode": "string", "role": "string", "user_status": "string", "disposition": "string", "created": "long"}
    moved = start + (F.unix_micros(F.col("requested_at").cast("timestamp")) - month) * 80
    acts = t.actions.select("user_id", moved.alias("at"), kind.alias("tag"), "id", (F.col("event_type") == "click").alias("ok"), *[F.lit(None).cast(k).alias(n) for n, k in none.items()]).where("tag IS NOT NULL")
    return jobs.drop("price").unionByName(rounds.drop("price")).unionByName(acts)


def _with_resets(t: Tables) -> DataFrame:
    return folds.run_batch(_history(t), "user_id", ["at", "tag", "id"], folds.moving(folds.enforce_all, limit=1, window=5, disable_limit=2), "user_id long, tag long, id long, action string, counted long")


#: Enforcement a row of a user's log at a time; the state is in columns. alone is true for jobs without what comes later.
_ENFORCEMENT = """
SELECT user_id, {columns}, unnest(acts) AS action, counted FROM (
WITH RECURSIVE jobs1 AS (
  SELECT j.id, j.user_id, epoch_us(created_at) AS us, enforcement_eligible AS eligible, violation_counted AS violation, run_mode, u.role, u.status AS user_status, CASE category_code WHEN 'R09' THEN 'notice_only' WHEN 'R08' THEN 'immediate_disable' ELSE '' END AS disposition, price
  FROM jobs j JOIN users u ON u.id = j.user_id WHERE j.status = 'done'
), log AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS n FROM (SELECT id, user_id, us AS tm, 0::BIGINT AS tag, true AS ok, us AS created, eligible, violation, run_mode, role, user_status, disposition FROM jobs1{later})
), run AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS tag, [{{'id': 0::BIGINT, 'bad': false}}][1:0] AS recent, true AS armed, 0::BIGINT AS counted, false AS escalated, NULL::BIGINT AS reset_at, '' AS dis, false AS resetting, false AS off, ['']::VARCHAR[] AS acts FROM log
  UNION ALL
  SELECT user_id, n, id, tag, recent1,
    CASE WHEN tag > 1 OR NOT eligible OR tag = 1 AND NOT ok THEN armed WHEN low THEN true WHEN tag = 0 THEN armed AND NOT bad ELSE armed END,
    counted1, escalated OR coalesce(warns AND run_mode = 'async', false), CASE WHEN tag = 4 AND resetting THEN tm ELSE reset_at END,
    CASE WHEN disables THEN 'waits' WHEN tag = 2 AND dis = 'waits' AND NOT resetting THEN '' WHEN tag = 3 AND dis <> '' AND ok THEN '' WHEN tag = 3 AND dis = 'waits' THEN 'unknown' ELSE dis END,
    CASE WHEN tag = 2 AND dis <> 'unknown' THEN true WHEN tag = 4 THEN false ELSE resetting END, CASE WHEN tag = 3 AND dis <> '' AND ok THEN true WHEN tag = 4 AND resetting THEN false ELSE off END,
    list_filter([CASE WHEN warns THEN 'warning' END, CASE WHEN warns AND run_mode = 'async' AND NOT escalated THEN 'escalation' END, CASE WHEN disables THEN 'disable' END,
      CASE WHEN tag = 1 AND ok AND eligible AND bad AND role = 'user' AND disposition <> 'notice_only' AND may THEN 'uncounted' END,
      CASE WHEN tag = 2 AND (dis = 'unknown' OR resetting) THEN 'refused' WHEN tag = 2 AND dis = 'waits' THEN 'cancelled' END, CASE WHEN tag = 2 AND dis <> 'unknown' AND NOT resetting THEN 'reset' END,
      CASE WHEN tag = 3 AND dis <> '' AND ok THEN 'disabled' WHEN tag = 3 AND dis = 'waits' THEN 'unknown' END, CASE WHEN tag = 4 AND resetting THEN 'enabled' END], lambda x: x IS NOT NULL)
  FROM (SELECT *, tag = 0 AND eligible AND NOT low AND armed AND bad AS warns, tag = 0 AND eligible AND bad AND role = 'user' AND user_status = 'active' AND NOT off AND disposition <> 'notice_only' AND (counted1 >= 2 OR disposition = 'immediate_disable') AND ({alone} OR dis = '') AS disables
    FROM (SELECT *, len(list_filter(recent1, lambda x: x.bad)) < 1 AS low,
      CASE WHEN tag = 0 AND eligible AND bad AND role = 'user' AND disposition <> 'notice_only' AND may THEN counted + 1 WHEN tag = 1 AND ok AND eligible AND bad AND role = 'user' AND disposition <> 'notice_only' AND may THEN greatest(0, counted - 1) WHEN tag = 4 AND resetting THEN 0 ELSE counted END AS counted1
      FROM (SELECT *, coalesce(violation, false) AS bad, reset_at IS NULL OR coalesce(created > reset_at, false) AS may,
        CASE WHEN tag = 0 AND eligible THEN list_append(recent, {{'id': id, 'bad': violation}})[-5:] WHEN tag = 1 AND ok AND eligible THEN list_transform(recent, lambda x: {{'id': x.id, 'bad': x.bad AND x.id <> log_id}}) ELSE recent END AS recent1
        FROM (SELECT l.*, l.id AS log_id, r.recent, r.armed, r.counted, r.escalated, r.reset_at, r.dis, r.resetting, r.off FROM run r JOIN log l ON l.user_id = r.user_id AND l.n = r.n + 1))))
) SELECT * FROM run WHERE n > 0)
"""
_LATER = """ UNION ALL SELECT id, user_id, us + CASE WHEN price % 2 = 0 THEN 40 ELSE 400 END * 86400000000, 1, true, us, eligible, violation, run_mode, role, user_status, disposition FROM jobs1 WHERE violation AND price % 3 = 0
    UNION ALL SELECT id, user_id, epoch_us(TIMESTAMP '1995-01-01') + (epoch_us(requested_at) - epoch_us(TIMESTAMP '2024-01-01')) * 80, CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END, event_type = 'click', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM actions WHERE event_type <> 'view'"""

query("g6_enforcement", _enforced, _ENFORCEMENT.format(columns="id AS job_id", order="id", later="", alone="true"))
query("g35_enable_and_reset", _with_resets, _ENFORCEMENT.format(columns="tag, id", order="tm, tag, id", later=_LATER, alone="false"))
query("g7_breakers", _breakers, "SELECT hash_key, user_id, job_id, CASE WHEN seen > 1 THEN 'repeated' WHEN users >= 2 THEN 'suppressed' ELSE 'countable' END AS outcome, CASE WHEN users >= 2 THEN 'tripped' ELSE '' END AS status, users FROM (SELECT *, sum((seen = 1)::BIGINT) OVER (PARTITION BY hash_key ORDER BY job_id, user_id)::BIGINT AS users FROM (SELECT *, row_number() OVER (PARTITION BY hash_key, user_id ORDER BY job_id) AS seen FROM (SELECT DISTINCT hash_key, user_id, job_id FROM targets t JOIN jobs j ON j.id = job_id WHERE kind = 'instruction' AND t.decision = 'block')))")
#: From each notice that goes out to the next one an hour later at the earliest.
_NOTICES = """
SELECT user_id, id, first AS sent, CASE WHEN first THEN coalesce(lag(held) OVER (PARTITION BY user_id, first ORDER BY n), 0) ELSE n - start END AS held_back FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id, start) - 1 AS held FROM (SELECT *, hit AS first, last_value(CASE WHEN hit THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n) AS start FROM (
    WITH RECURSIVE notices AS (
      SELECT id, user_id, epoch(requested_at)::BIGINT AS tm, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(requested_at)), id) AS n FROM actions WHERE event_type = 'error'
    ), nexts AS (
      SELECT a.user_id, a.n, (SELECT min(b.n) FROM notices b WHERE b.user_id = a.user_id AND b.n > a.n AND b.tm - a.tm >= 3600) AS following FROM notices a
    ), out AS (
      SELECT user_id, n FROM notices WHERE n = 1 UNION ALL SELECT x.user_id, x.following FROM out o JOIN nexts x ON x.user_id = o.user_id AND x.n = o.n WHERE x.following IS NOT NULL
    )
    SELECT s.*, o.n IS NOT NULL AS hit FROM notices s LEFT JOIN out o ON o.user_id = s.user_id AND o.n = s.n)))
"""
query("g5_flights", _flights, _FLIGHTS)
query("g8_operated_breakers", _operated, _OPERATED)
query("g9_throttled_notices", _throttled, _NOTICES)
query("g10_due_jobs", lifecycle.due_jobs, "SELECT id, created_at FROM jobs WHERE status IN ('queued', 'retry') ORDER BY created_at, id LIMIT 50")
_HEALTH = """
SELECT model_id, tm AS at_s, health, until::DOUBLE AS cooldown_until, latency AS latency_ewma FROM (
WITH RECURSIVE log AS (
  SELECT model_id, epoch(dispatch_started_at)::BIGINT AS tm, latency_ms, CASE WHEN status = 'succeeded' THEN '' WHEN line = 2 THEN 'rate_limited' ELSE 'timeout' END AS error, row_number() OVER (PARTITION BY model_id ORDER BY dispatch_started_at, job_id, line, latency_ms) AS n FROM attempts
), run AS (
  SELECT DISTINCT model_id, 0::BIGINT AS n, 0::BIGINT AS tm, 'unknown' AS health, 0::BIGINT AS fails, 0::BIGINT AS opened, NULL::BIGINT AS until, NULL::DOUBLE AS latency FROM log
  UNION ALL
  SELECT model_id, n, tm, CASE WHEN error = '' THEN 'healthy' WHEN cools THEN 'cooldown' ELSE 'degraded' END, CASE WHEN error = '' THEN 0 ELSE fails + 1 END, CASE WHEN error = '' THEN 0 WHEN cools THEN opened + 1 ELSE opened END,
    CASE WHEN error = '' THEN NULL WHEN error = 'rate_limited' THEN tm + 30 WHEN cools THEN tm + least(300, 15 * pow(2, opened)::BIGINT) ELSE until END, CASE WHEN latency_ms > 0 THEN coalesce(0.2::DOUBLE * latency_ms + 0.8::DOUBLE * latency, latency_ms) ELSE latency END
  FROM (SELECT l.*, r.fails, r.opened, r.until, r.latency, error <> '' AND (error = 'rate_limited' OR r.fails + 1 >= 2) AS cools FROM run r JOIN log l ON l.model_id = r.model_id AND l.n = r.n + 1)
) SELECT * FROM run WHERE n > 0)
"""
_DETECTED = """
SELECT epoch, tm AS fetched_s, rule, CASE WHEN fires THEN 'automatic:' || epoch || ':' || before END AS event_key, reset_at::DOUBLE AS reset_at_s, base::DOUBLE AS baseline_s FROM (
WITH RECURSIVE log AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN 0 ELSE tm // 604800 * 604800 + 604800 + user_id * 60 END AS reset FROM (SELECT user_id, 'e' || user_id AS epoch, epoch(requested_at)::BIGINT AS tm, event_type, abs(value) AS used, row_number() OVER (PARTITION BY user_id ORDER BY epoch(requested_at)::BIGINT, id) AS n FROM (SELECT * REPLACE (date_trunc('second', requested_at) AS requested_at) FROM actions))
), run AS (
  SELECT DISTINCT epoch, 0::BIGINT AS n, 0::BIGINT AS tm, '' AS rule, false AS fires, NULL::BIGINT AS before, NULL::BIGINT AS reset_at, NULL::BIGINT AS base, NULL::DOUBLE AS used, NULL::BIGINT AS fetched, false AS awaiting FROM log
  UNION ALL
  SELECT epoch, n, tm, rule, rule IN ('natural', 'early', 'ended'), base, CASE rule WHEN 'natural' THEN greatest(base, reset - 604800) WHEN 'early' THEN tm WHEN 'ended' THEN base END, CASE WHEN rule <> 'refused' AND reset > tm THEN reset ELSE base END,
    CASE WHEN rule = 'refused' THEN last_used ELSE used END, CASE WHEN rule = 'refused' THEN fetched ELSE tm END, CASE rule WHEN 'awaited' THEN false WHEN 'ended' THEN true ELSE awaiting END
  FROM (SELECT l.*, r.base, r.used AS last_used, r.fetched, r.awaiting,
    CASE WHEN l.tm <= r.fetched THEN 'refused' WHEN reset > l.tm THEN CASE WHEN r.base IS NULL THEN 'first' WHEN r.awaiting THEN 'awaited' WHEN reset - r.base > 518400 AND l.tm >= r.base THEN 'natural' WHEN reset - r.base > 518400 AND r.used > 0 THEN 'early' WHEN reset - r.base > 518400 THEN 'drift' WHEN reset - r.base < -518400 THEN 'back' ELSE 'same' END
      WHEN reset > 0 THEN 'not_switched' WHEN r.base IS NOT NULL AND NOT r.awaiting AND l.tm >= r.base AND l.used = 0 THEN 'ended' ELSE 'no_reset_time' END AS rule
    FROM run r JOIN log l ON l.epoch = r.epoch AND l.n = r.n + 1)
) SELECT * FROM run WHERE n > 0)
"""
query("g13_node_health", _health, _HEALTH)
_LAST = _HEALTH.replace("SELECT model_id, tm AS at_s, health, until::DOUBLE AS cooldown_until, latency AS latency_ewma FROM (", "SELECT model_id, arg_max(health, n) AS health, arg_max(tm, n) AS seen FROM (") + " GROUP BY model_id"
query(
    "h7_inbox_board",
    lambda t: console.inbox_board(t, _health(t, "model_id long, at_s long, health string, calls long")),
    "SELECT * FROM (WITH a AS (SELECT 'action_failed' AS category, count(*) AS n, max(requested_at) AS newest FROM actions WHERE execution_status IN ('failed', 'unknown') UNION ALL SELECT 'notification_failed', count(*), max(requested_at) FROM actions WHERE notification_status = 'failed' AND requested_at >= TIMESTAMP '2024-01-13' "
    "UNION ALL SELECT 'failure_rate', 1, max(requested_at) FROM actions WHERE requested_at BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20' HAVING count(*) >= 5 AND count(*) FILTER (WHERE execution_status = 'failed') / count(*) >= 0.2 UNION ALL SELECT 'breaker_pending', count(*), NULL FROM breakers WHERE status = 'tripped' "
    f"UNION ALL SELECT 'node_unhealthy', count(*), make_timestamp(max(seen) * 1000000) FROM ({_LAST}) WHERE health NOT IN ('healthy', 'unknown', 'disabled')) SELECT * FROM a UNION ALL SELECT 'total', sum(n)::BIGINT, max(newest) FROM a)",
)
query("g17_reset_detector", _resets, _DETECTED)
query("g18_reset_events", quota.reset_events, "SELECT event_key, min(id) AS event_id, arg_min(user_id, id) AS monitor, arg_min(requested_at, id) AS reset_at FROM (SELECT *, 'automatic:' || user_id || ':' || strftime(requested_at, '%Y-%m-%d') AS event_key FROM actions WHERE execution_status = 'failed') GROUP BY 1")
query("g19_fan_out", quota.fan_out, f"SELECT group_id, batch, count(*) * 3 AS records, count(*) AS items, min(id) AS first FROM (SELECT u.id, group_id, (row_number() OVER (PARTITION BY group_id ORDER BY u.id) - 1) // 100 AS batch FROM {_SUBS}) GROUP BY 1, 2")
query("g20_superseded", quota.superseded, "SELECT event_id, monitor, CASE WHEN event_id < max(event_id) OVER (PARTITION BY monitor) THEN 'skipped' ELSE 'pending' END AS status FROM (SELECT min(id) AS event_id, min(user_id) AS monitor FROM actions WHERE execution_status = 'failed' GROUP BY user_id, strftime(requested_at, '%Y-%m-%d'))")
query("g21_delivered", quota.delivered, f"SELECT group_id, batch, count(*) AS items, count(*) FILTER (WHERE st = 'succeeded') AS succeeded, CASE WHEN bool_or(st = 'uncertain') THEN 'uncertain' WHEN bool_or(st = 'failed') THEN 'partial' ELSE 'succeeded' END AS status FROM (SELECT s.*, CASE WHEN last IS NULL THEN 'uncertain' WHEN last = 'failed' THEN 'failed' ELSE 'succeeded' END AS st FROM (SELECT u.id, group_id, (row_number() OVER (PARTITION BY group_id ORDER BY u.id) - 1) // 100 AS batch FROM {_SUBS}) s LEFT JOIN (SELECT user_id, arg_max(status, id) AS last FROM jobs GROUP BY 1) r ON r.user_id = s.id) GROUP BY 1, 2")
def _buckets(t: Tables) -> DataFrame:
    rows = t.actions.select(F.col("user_id").alias("connection"), "id", (F.unix_micros(F.col("requested_at").cast("timestamp")) / 3_600_000_000).alias("at_s"))
    return folds.run_batch(rows, "connection", ["at_s", "id"], folds.moving(folds.token_bucket, burst=3, rate=0.05), "connection long, id long, allowed boolean")


_BUCKETS = """
SELECT connection, id, allowed FROM (
WITH RECURSIVE log AS (
  SELECT user_id AS connection, id, epoch_us(requested_at)::DOUBLE / 3600000000::DOUBLE AS tm, row_number() OVER (PARTITION BY user_id ORDER BY requested_at, id) AS n FROM actions
), run AS (
  SELECT DISTINCT connection, 0::BIGINT AS n, 0::BIGINT AS id, 3::DOUBLE AS left_, NULL::DOUBLE AS last, false AS allowed FROM log
  UNION ALL
  SELECT connection, n, id, CASE WHEN now >= 1 THEN now - 1 ELSE now END, tm, now >= 1 FROM (SELECT l.*, least(3::DOUBLE, r.left_ + 0.05::DOUBLE * greatest(0::DOUBLE, l.tm - coalesce(r.last, l.tm))) AS now FROM run r JOIN log l ON l.connection = r.connection AND l.n = r.n + 1)
) SELECT * FROM run WHERE n > 0)
"""
query("g24_token_buckets", _buckets, _BUCKETS)
query("g24_rate_windows", quota.rate_windows, "SELECT user_id, date_trunc('minute', requested_at)::TIMESTAMP AS minute, count(*) AS n, greatest(count(*) - 2, 0) AS rejected FROM actions GROUP BY 1, 2")
query("g25_kept_jobs", lambda t: lifecycle.kept_jobs(t).select("id", "status"), "SELECT id, status FROM jobs WHERE created_at >= TIMESTAMP '1995-06-01' OR status = 'queued'")
query("g26_erased_texts", lifecycle.erased_texts, "SELECT DISTINCT hash_key FROM targets WHERE job_id IN (SELECT id FROM jobs WHERE user_id = 7) AND hash_key NOT IN (SELECT hash_key FROM targets WHERE job_id NOT IN (SELECT id FROM jobs WHERE user_id = 7)) AND hash_key NOT IN (SELECT hash_key FROM trust) AND hash_key NOT IN (SELECT hash_key FROM breakers)")
query("g27_next_round", lifecycle.next_round, "SELECT job_id, round + 1 AS round, target_order, hash_key, kind FROM targets t JOIN jobs j ON j.id = job_id AND round = current_round WHERE j.decision = 'block'")
query("g28_policy_replay", lifecycle.policy_replay, "SELECT id, expected, CASE WHEN b >= n // 2 + 1 THEN 'block' WHEN b + r > 0 THEN 'review' ELSE 'pass' END AS decision FROM (SELECT s.id, s.expected, count(*) FILTER (WHERE x >= 60) AS b, count(*) FILTER (WHERE x >= 30 AND x < 60) AS r, count(*) AS n FROM (SELECT s.*, (s.id * 31 + model_id * 17) % 100 AS x FROM samples s CROSS JOIN (SELECT model_id FROM nodes WHERE enabled)) s GROUP BY 1, 2)")

# --- read products ------------------------------------------------------------------------------------------------------------------

_RISK = f"SELECT a.user_id, coalesce(username, '') AS username, coalesce(email, '') AS email, coalesce(role, '') AS role, coalesce(u.status, '') AS user_status, a.jobs, blocks, reviews, violations, last_block_at, coalesce(p.n, 0)::BIGINT AS pending, coalesce(array_to_string(c.cats, ','), '') AS categories FROM (SELECT user_id, count(*) AS jobs, count(*) FILTER (WHERE decision = 'block') AS blocks, count(*) FILTER (WHERE decision = 'review') AS reviews, count(*) FILTER (WHERE violation_counted) AS violations, max(created_at) FILTER (WHERE decision = 'block') AS last_block_at FROM jobs WHERE {RANGE} GROUP BY 1) a LEFT JOIN (SELECT * FROM users WHERE NOT deleted) u ON u.id = a.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM actions WHERE execution_status IN ('pending', 'processing', 'unknown') GROUP BY 1) p ON p.user_id = a.user_id LEFT JOIN (SELECT user_id, arg_max(trigger_categories, id) AS cats FROM jobs WHERE decision = 'block' AND trigger_categories IS NOT NULL GROUP BY 1) c ON c.user_id = a.user_id "
query("h5_risk_users", boards.risk_users, _RISK + "ORDER BY blocks DESC, a.user_id LIMIT 20")
query("h5_risk_users_recent", lambda t: boards.risk_users(t, "last_block_at", number=2), _RISK + "ORDER BY last_block_at DESC NULLS LAST, a.user_id LIMIT 20 OFFSET 20")
query("h5_risk_users_keyword", lambda t: boards.risk_users(t, "violations", keyword="12"), _RISK + "WHERE coalesce(username, '') ILIKE '%12%' OR coalesce(email, '') ILIKE '%12%' OR a.user_id = 12 ORDER BY violations DESC, a.user_id LIMIT 20")
query("h15_audit_users", boards.audit_users, "SELECT u.id, lower(username) AS username, coalesce(n, 0)::BIGINT AS jobs, n IS NOT NULL AS has_jobs FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM jobs GROUP BY 1) j ON j.user_id = u.id WHERE NOT deleted AND u.status = 'active'")
query("h19_subscriptions", quota.subscriptions, f"SELECT u.id AS subscription_id, u.id AS user_id, group_id, username, platform FROM {_SUBS}")

# --- configuration, admission, delivery ---------------------------------------------------------------------------------------------

for _name, _make, _sql in [*transitions.REPORTS, *clients.REPORTS, *bodies.REPORTS, *console.REPORTS]:
    query(_name, _make, _sql)
