"""The moderation tables, read from Parquet.

The driver's star schema stands in for the audit store: orders are jobs, line items are targets and calls, parts are
instruction hashes, customers are users. Each property is a lazy DataFrame; nothing is cached, so column pruning and
filters reach the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

JOBS = """
  o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status,
  CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN CAST(floor(o_totalprice) AS bigint) % 10 = 0 THEN 'block'
       WHEN CAST(floor(o_totalprice) AS bigint) % 10 < 3 THEN 'review' ELSE 'pass' END AS decision,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'blocking' ELSE 'async' END AS run_mode,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(floor(o_totalprice) AS bigint) % 5000 END AS blocking_wait_ms,
  CASE o_orderkey % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini_cli' ELSE 'generic' END AS client_fingerprint,
  'R0' || CAST(1 + o_orderkey % 9 AS varchar(1)) AS category_code, o_orderkey % 3 <> 0 AS enforcement_eligible,
  o_orderkey % 7 = 0 AS orphan_continuation, CASE WHEN o_orderkey % 11 = 0 THEN 'reaudit' ELSE 'request' END AS run_kind,
  1 + o_orderkey % 2 AS current_round, CAST(floor(o_totalprice) AS bigint) AS price,
  o_custkey * 10 + o_orderkey % 3 AS api_key_id, 'req-' || CAST(o_orderkey AS varchar(20)) AS request_id, 'model-' || substr(o_orderpriority, 1, 1) AS model,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'responses' WHEN '2' THEN 'gemini' WHEN '3' THEN 'anthropic_messages' ELSE 'chat_completions' END AS protocol
"""
#: The rest of a node's configuration, as SELECT items over supplier that both engines read.
NODE_FIELDS = "'https://n' || CAST(s_nationkey AS varchar(5)) || '.example.com/v1' AS base_url, 'scorer-' || CAST(s_nationkey % 7 AS varchar(5)) AS model, CASE s_nationkey % 4 WHEN 0 THEN 'responses' WHEN 1 THEN 'anthropic_messages' WHEN 2 THEN 'gemini' ELSE 'chat_completions' END AS api_format, CAST(abs(floor(s_acctbal)) AS bigint) + 1000 AS timeout_ms"
#: Subscriptions: orders stand for them.
SUBSCRIPTIONS = "o_orderkey AS id, o_custkey AS user_id, CAST(floor(o_totalprice) AS bigint) % 25 AS group_id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'P' THEN 'suspended' ELSE 'expired' END AS status, o_orderdate AS starts_at, substr(o_orderpriority, 1, 1) = '5' AS deleted, o_totalprice AS used"
#: What groups have besides: their state, kind and platform.
GROUP_FIELDS = "n_nationkey % 9 = 8 AS deleted, CASE WHEN length(n_name) % 4 = 3 THEN 'disabled' ELSE 'active' END AS status, CASE WHEN n_regionkey < 4 THEN 'openai' ELSE 'gemini' END AS platform, CASE WHEN n_nationkey % 5 = 4 THEN 'balance' ELSE 'subscription' END AS subscription_type"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id", "c_name AS username", "lower(c_name) || '@example.com' AS email", "CASE WHEN c_custkey % 20 = 0 THEN 'admin' ELSE 'user' END AS role",
            "CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status", "c_mktsegment = 'MACHINERY' AS deleted", "c_nationkey AS group_id", "c_acctbal AS balance",
        )

    @cached_property
    def groups(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).selectExpr("n_nationkey AS id", "n_name AS name", "r_name AS platform")

    @cached_property
    def jobs(self) -> DataFrame:
        jobs = self.raw("orders").selectExpr(*[c for c in _split(JOBS)])
        return jobs.selectExpr(
            "*", "CASE WHEN decision = 'block' AND id % 13 <> 0 THEN array(category_code, 'R0' || CAST(1 + id % 4 AS string)) WHEN decision = 'block' THEN CAST(NULL AS array<string>) ELSE CAST(array() AS array<string>) END AS trigger_categories",
            "CASE WHEN status <> 'queued' THEN timestampadd(SECOND, CAST(price % 600 AS int), created_at) END AS started_at",
            "CASE WHEN status <> 'queued' THEN timestampadd(SECOND, CAST(price % 600 + price % 90 AS int), created_at) END AS finished_at",
            "coalesce(decision = 'block' AND enforcement_eligible, false) AS violation_counted",
        )

    @cached_property
    def targets(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS job_id", "l_linenumber AS target_order", "l_partkey AS hash_key", "CASE WHEN l_linenumber = 1 THEN 'user' ELSE 'instruction' END AS kind",
            "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN 'cache' WHEN l_returnflag = 'R' THEN 'model' ELSE 'trust' END AS resolution",
            "1 + l_linenumber % 2 AS round", "CASE WHEN l_returnflag <> 'N' THEN l_orderkey END AS review_id",
            "CASE CAST(l_quantity AS bigint) % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'review' WHEN 2 THEN 'pass' END AS decision",
        )

    @cached_property
    def attempts(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS job_id", "l_suppkey AS model_id", "l_shipdate AS dispatch_started_at", "CASE WHEN l_linenumber = 7 THEN 'probe' ELSE 'audit' END AS call_kind",
            "CASE WHEN l_linenumber = 6 THEN 'format_repair' WHEN l_linenumber = 1 THEN 'user' ELSE 'instruction' END AS stage",
            "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS status", "CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS bigint) * 100 END AS input_tokens",
            "CAST(l_quantity AS bigint) AS output_tokens", "CAST(floor(l_extendedprice) AS bigint) % 3000 AS latency_ms", "floor(l_discount * 1000) / 100 AS confidence",
            "l_linenumber AS line", "l_partkey AS hash_key",
        )

    @cached_property
    def nodes(self) -> DataFrame:
        return self.raw("supplier").selectExpr("s_suppkey AS model_id", "CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name", "s_acctbal >= 0 AS enabled")

    @cached_property
    def node_configs(self) -> DataFrame:
        return self.raw("supplier").selectExpr("s_suppkey AS model_id", "s_acctbal >= 0 AS enabled", *_split(NODE_FIELDS))

    @cached_property
    def subscriptions(self) -> DataFrame:
        return self.raw("orders").selectExpr(*_split(SUBSCRIPTIONS))

    @cached_property
    def quota_groups(self) -> DataFrame:
        return self.raw("nation").selectExpr("n_nationkey AS id", "n_name AS name", *_split(GROUP_FIELDS))

    @cached_property
    def reviews(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id", "o_orderkey % 400 AS hash_key", "o_orderkey % 3 AS eval_key", "o_orderdate AS created_at", "o_orderkey % 5 <> 0 AS reusable",
            "(CAST(floor(o_totalprice) AS bigint) % 1000) / 1000.0D AS score",
        )

    @cached_property
    def trust(self) -> DataFrame:
        return self.raw("part").where("p_size <= 5").selectExpr("p_partkey AS hash_key")

    @cached_property
    def breakers(self) -> DataFrame:
        return self.raw("part").where("p_size > 40").selectExpr("p_partkey AS hash_key", "CASE p_size % 3 WHEN 0 THEN 'tripped' WHEN 1 THEN 'trusted' ELSE 'confirmed' END AS status", "p_size AS distinct_users")

    @cached_property
    def texts(self) -> DataFrame:
        """Prompt texts: one of each instruction hash, with the part's name as text."""
        return self.raw("part").selectExpr("p_partkey AS hash_key", "p_name AS text", "p_brand AS brand", "p_size AS size", "p_retailprice AS price")

    @cached_property
    def actions(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id", "user_id", "ts AS requested_at", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'unknown' WHEN 'click' THEN 'pending' ELSE 'succeeded' END AS execution_status",
            "CASE event_type WHEN 'view' THEN 'failed' ELSE 'sent' END AS notification_status", "props AS business_snapshot", "value", "event_type",
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.raw("labels").selectExpr("doc_id AS id", "CASE WHEN toxic = 1 THEN 'block' ELSE 'pass' END AS expected", "CASE WHEN quality = 1 THEN 'pass' ELSE 'block' END AS actual")

    @cached_property
    def prompts(self) -> DataFrame:
        return self.raw("documents").selectExpr("doc_id AS id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'instruction' ELSE 'user' END AS kind", "lang", "source")

    @cached_property
    def turns(self) -> DataFrame:
        return self.raw("conversations")


def _split(columns: str) -> list[str]:
    """Select items of a list: commas within parentheses don't part."""
    out, depth, part = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]
