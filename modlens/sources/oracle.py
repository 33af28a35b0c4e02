"""The same tables as DuckDB views, for the SQL that the queries are checked against."""

from __future__ import annotations

from modlens.sources.tables import GROUP_FIELDS, JOBS, NODE_FIELDS, SUBSCRIPTIONS

VIEWS = {
    "users": "SELECT c_custkey AS id, c_name AS username, lower(c_name) || '@example.com' AS email, CASE WHEN c_custkey % 20 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status, c_mktsegment = 'MACHINERY' AS deleted, c_nationkey AS group_id, c_acctbal AS balance FROM customer",
    "grps": "SELECT n_nationkey AS id, n_name AS name, r_name AS platform FROM nation JOIN region ON n_regionkey = r_regionkey",
    "jobs0": f"SELECT {JOBS} FROM orders",
    "jobs": "SELECT *, CASE WHEN decision = 'block' AND id % 13 <> 0 THEN [category_code, 'R0' || CAST(1 + id % 4 AS varchar)] WHEN decision = 'block' THEN NULL ELSE CAST([] AS varchar[]) END AS trigger_categories, CASE WHEN status <> 'queued' THEN created_at + to_seconds(price % 600) END AS started_at, CASE WHEN status <> 'queued' THEN created_at + to_seconds(price % 600 + price % 90) END AS finished_at, coalesce(decision = 'block' AND enforcement_eligible, false) AS violation_counted FROM jobs0",
    "targets": "SELECT l_orderkey AS job_id, l_linenumber AS target_order, l_partkey AS hash_key, CASE WHEN l_linenumber = 1 THEN 'user' ELSE 'instruction' END AS kind, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN 'cache' WHEN l_returnflag = 'R' THEN 'model' ELSE 'trust' END AS resolution, 1 + l_linenumber % 2 AS round, CASE WHEN l_returnflag <> 'N' THEN l_orderkey END AS review_id, CASE CAST(l_quantity AS bigint) % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'review' WHEN 2 THEN 'pass' END AS decision FROM lineitem",
    "attempts": "SELECT l_orderkey AS job_id, l_suppkey AS model_id, l_shipdate AS dispatch_started_at, CASE WHEN l_linenumber = 7 THEN 'probe' ELSE 'audit' END AS call_kind, CASE WHEN l_linenumber = 6 THEN 'format_repair' WHEN l_linenumber = 1 THEN 'user' ELSE 'instruction' END AS stage, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS bigint) * 100 END AS input_tokens, CAST(l_quantity AS bigint) AS output_tokens, CAST(floor(l_extendedprice) AS bigint) % 3000 AS latency_ms, floor(l_discount * 1000) / 100 AS confidence, l_linenumber AS line, l_partkey AS hash_key FROM lineitem",
    "nodes": "SELECT s_suppkey AS model_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name, s_acctbal >= 0 AS enabled FROM supplier",
    "reviews": "SELECT o_orderkey AS id, o_orderkey % 400 AS hash_key, o_orderkey % 3 AS eval_key, o_orderdate AS created_at, o_orderkey % 5 <> 0 AS reusable, (CAST(floor(o_totalprice) AS bigint) % 1000) / 1000.0::DOUBLE AS score FROM orders",
    "trust": "SELECT p_partkey AS hash_key FROM part WHERE p_size <= 5",
    "breakers": "SELECT p_partkey AS hash_key, CASE p_size % 3 WHEN 0 THEN 'tripped' WHEN 1 THEN 'trusted' ELSE 'confirmed' END AS status, p_size AS distinct_users FROM part WHERE p_size > 40",
    "texts": "SELECT p_partkey AS hash_key, p_name AS text, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part",
    "actions": "SELECT event_id AS id, user_id, ts AS requested_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'unknown' WHEN 'click' THEN 'pending' ELSE 'succeeded' END AS execution_status, CASE event_type WHEN 'view' THEN 'failed' ELSE 'sent' END AS notification_status, props AS business_snapshot, value, event_type FROM events",
    "samples": "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'block' ELSE 'pass' END AS expected, CASE WHEN quality = 1 THEN 'pass' ELSE 'block' END AS actual FROM labels",
    "prompts": "SELECT doc_id AS id, text, CASE WHEN doc_id % 2 = 0 THEN 'instruction' ELSE 'user' END AS kind, lang, source FROM documents",
    "turns": "SELECT * FROM conversations",
    "node_configs": f"SELECT s_suppkey AS model_id, s_acctbal >= 0 AS enabled, {NODE_FIELDS} FROM supplier",
    "subscriptions": f"SELECT {SUBSCRIPTIONS} FROM orders",
    "quota_groups": f"SELECT n_nationkey AS id, n_name AS name, {GROUP_FIELDS} FROM nation",
}


def sql(body: str) -> str:
    """body, a SELECT over the views, as one statement."""
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + " " + body
