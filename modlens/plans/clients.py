"""Reports of what clients and providers send: template rules, model lists, hosts, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.catalog import ANTHROPIC, GOOGLE, eligibility, ip_verdict, model_ids, private_host
from modlens.functions.templates import apply_templates
from modlens.sources.tables import Tables

_ENV = "<env>\nPlatform: linux\nOS Version: 6\n</env>"
_ROOTS = "<environment_context>\n  <cwd>/a</cwd>\n  <writable_roots>\n    <root>/a</root>\n  </writable_roots>\n</environment_context>"
_AGENTS = "# AGENTS.md instructions for /a\n\n<INSTRUCTIONS>\nx\n</INSTRUCTIONS>"
_BILLING = "x-anthropic-billing-header: cc_version=1"


def stripped_prompts(t: Tables) -> DataFrame:
    """Prompts with parts that clients put around them, and what the template rules leave of each kind, by its length."""
    kind, text = F.col("id") % 6, F.coalesce("text", F.lit(""))
    made = F.when(kind == 0, F.concat(text, F.lit(_ENV))).when(kind == 1, F.concat(F.lit(_ENV.replace("Platform", "Secret")), text)).when(kind == 2, F.lit(_ROOTS)).when(kind == 3, F.lit(_AGENTS)).when(kind == 4, F.lit(_BILLING)).otherwise(text)
    client = F.when(kind.isin(2, 3), "codex").when(kind == 5, "generic").otherwise("claude_code")
    role = F.when(kind.isin(0, 1, 4), "system").otherwise("user")
    blocks = t.prompts.select("id", client.alias("client"), role.alias("role"), F.lit(False).alias("first_message"), (F.col("id") % 4 < 2).alias("context_prefix"), made.alias("text"))
    out = apply_templates(blocks)
    return out.select("id", F.length("kept").cast("long").alias("n"), F.array_join("stripped", ",").alias("rules"), "dropped", "instruction")


def model_lists(t: Tables) -> DataFrame:
    """Ids in the model list that each node answers with."""
    kind, name = F.col("model_id") % 4, F.coalesce("name", F.lit(""))
    plain = F.to_json(F.struct(F.array(F.struct(name.alias("id")), F.struct(F.lit(" m ").alias("id")), F.struct(name.alias("id"))).alias("data")))
    google = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("models/"), name).alias("name")), F.struct(F.lit("m").alias("name"))).alias("models")))
    body = F.when(kind == 0, google).when(kind == 1, F.lit("no list")).otherwise(plain)
    api = F.when(kind == 0, GOOGLE).when(kind == 2, ANTHROPIC).otherwise("openai_compatible")
    return t.nodes.select("model_id", F.array_join(model_ids(body, api), ",").alias("ids"))


def private_nodes(t: Tables) -> DataFrame:
    n = F.col("model_id") % 256
    url = F.when(n % 3 == 0, F.concat(F.lit("https://172."), n.cast("string"), F.lit(".0.1:8443/v1"))).when(n % 3 == 1, F.concat(F.lit("http://n"), n.cast("string"), F.lit(".localhost"))).otherwise("https://user@api.example.com/v1?x=10.0.0.1")
    return t.nodes.select("model_id", private_host(url).alias("private"))


def key_eligibility(t: Tables) -> DataFrame:
    """Eligibility of a key of each user, asked from an address that the user's id tells."""
    groups = t.groups.select(F.col("id").alias("gid"), "platform")
    users = t.users.join(groups, F.col("group_id") == F.col("gid"), "left")
    i = F.col("id")
    white = F.when(i % 5 == 0, F.array(F.lit("10.0.0.0/25"))).when(i % 7 == 0, F.array(F.lit("no rule")))
    black = F.when(i % 4 == 0, F.array(F.lit("10.0.0.2")))
    ip = F.concat(F.lit("10.0.0."), (i % 200).cast("string"))
    key = F.when(~F.col("deleted"), F.when(i % 9 == 0, "revoked").otherwise("active"))
    platform = F.when(F.col("platform") == "AFRICA", "composite").otherwise(F.col("platform"))
    return users.select("id", eligibility(key, F.col("status"), i % 8 == 1, F.when(F.col("gid").isNotNull(), "active"), i % 6 != 5, ip_verdict(ip, white, black), platform).alias("eligibility"))


_N = "model_id % 256"
REPORTS = [
    ("a24_model_lists", model_lists, "SELECT model_id, CASE WHEN model_id % 4 = 1 THEN NULL WHEN coalesce(name, '') = '' THEN 'm' ELSE name || ',m' END AS ids FROM nodes"),
    ("b14_key_eligibility", key_eligibility, "SELECT u.id, CASE WHEN deleted OR u.id % 9 = 0 OR status <> 'active' OR u.id % 8 = 1 OR g.id IS NULL OR u.id % 6 = 5 THEN 'rejected' WHEN u.id % 7 = 0 AND u.id % 5 <> 0 THEN 'unknown' WHEN u.id % 4 = 0 AND u.id % 200 = 2 OR u.id % 5 = 0 AND u.id % 200 >= 128 THEN 'rejected' WHEN platform = 'AFRICA' THEN 'unknown' ELSE 'passed' END AS eligibility FROM users u LEFT JOIN grps g ON g.id = group_id"),
    ("f19_stripped_prompts", stripped_prompts, f"SELECT id, CASE id % 6 WHEN 0 THEN length(coalesce(text, '')) WHEN 1 THEN length(coalesce(text, '')) + {len(_ENV.replace('Platform', 'Secret'))} WHEN 2 THEN 0 WHEN 3 THEN {len(_AGENTS)} WHEN 4 THEN 0 ELSE length(coalesce(text, '')) END::BIGINT AS n, CASE id % 6 WHEN 0 THEN 'claude_env' WHEN 2 THEN 'codex_environment_context' WHEN 3 THEN CASE WHEN id % 4 < 2 THEN 'codex_agents_md' ELSE '' END WHEN 4 THEN 'claude_billing_header' ELSE '' END AS rules, id % 6 IN (2, 4) AS dropped, id % 6 = 3 AND id % 4 < 2 AS instruction FROM prompts"),
    ("f26_private_nodes", private_nodes, f"SELECT model_id, CASE {_N} % 3 WHEN 0 THEN {_N} BETWEEN 16 AND 31 WHEN 1 THEN true ELSE false END AS private FROM nodes"),
]
