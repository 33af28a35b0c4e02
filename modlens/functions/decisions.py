"""Column functions of decisions, votes, categories and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
REASON_PREFIXES = ("违规/", "待复核/", "指令风险/")
IMMEDIATE, NOTICE_ONLY = "immediate_disable", "notice_only"


def severity(decision: Column) -> Column:
    """block 3, review 2, pass 1, none 0."""
    return F.when(decision == "block", 3).when(decision == "review", 2).when(decision == "pass", 1).otherwise(0)


def classify(score: Column, review: float, block: float) -> Column:
    return F.when(score >= block, "block").when(score >= review, "review").when(score.isNotNull(), "pass")


def block_threshold(rule: str, nodes: Column) -> Column:
    """How many nodes must vote block: all, more than half, or one."""
    if rule == "all_block":
        return nodes
    if rule == "majority_block":
        return F.floor(nodes / 2) + 1
    if rule == "any_block":
        return F.lit(1).cast("long")
    raise ValueError(f"unknown aggregation rule: {rule}")


def vote_outcome(rule: str, blocks: Column, reviews: Column, failures: Column, skipped: Column, nodes: Column) -> Column:
    """struct(decision, partial, failure) of the counted votes; nodes is the fixed denominator, unknown votes included.

    Enough blocks decide. Short of that a skipped node leaves the result invalid, and failures that could have made up
    the difference leave the audit unavailable; else any block, review or failure asks for a review.
    """
    need = block_threshold(rule, nodes)
    decided = blocks >= need
    invalid = ~decided & (skipped > 0)
    short = ~decided & ~invalid & (blocks + failures >= need)
    empty = nodes == 0
    decision = F.when(empty | invalid | short & ~decided, None).when(decided, "block").when(blocks + reviews + failures > 0, "review").otherwise("pass")
    failure = F.when(empty, "no_models").when(invalid, "invalid_model_result").when(short, "audit_unavailable")
    return F.struct(decision.alias("decision"), (failures > 0).alias("partial"), failure.alias("failure"))


def reason_codes(reason: Column, declared: Column | None = None) -> Column:
    """The distinct category codes before the first colon of a reason with a known prefix, in their order; null if none."""
    head = F.regexp_extract(F.trim(reason), r"^([^:：]+)[:：]", 1)
    rest = F.lit("")
    for p in REASON_PREFIXES:
        rest = F.when(head.startswith(p), F.substring(head, len(p) + 1, 1 << 20)).otherwise(rest)
    codes = F.array_distinct(F.filter(F.split(rest, r"[、,，/ ]"), lambda c: c.rlike(r"^R\d{2}$")))
    if declared is not None:
        codes = F.filter(codes, lambda c: F.array_contains(declared, c))
    return F.when(F.size(codes) > 0, codes)


def policy_names(policy: Column) -> Column:
    """A map of category code to name from lines such as "R01 Name"; of repeated codes the last line counts."""
    lines = F.filter(F.transform(F.split(policy, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^R\d{2} .+$"))
    pairs = F.transform(lines, lambda x: F.struct(F.left(x, F.lit(3)).alias("code"), F.trim(F.substring(x, 5, 1 << 20)).alias("name")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["code"] == p["code"]))
    return F.map_from_entries(last)


def target_codes(nodes: Column, decision: Column, declared: Column, review: float, block: float) -> Column:
    """Sorted categories of the nodes whose vote supports the decision; null for pass, none or no codes.

    nodes: array<struct<confidence, reason, failed, skipped>>.
    """
    valid = F.filter(nodes, lambda n: n["confidence"].isNotNull() & ~n["failed"] & ~n["skipped"])
    least = F.when(decision == "block", F.lit(block)).when(decision == "review", F.lit(review))
    backing = F.filter(valid, lambda n: n["confidence"] >= least)
    codes = F.array_sort(F.array_distinct(F.flatten(F.transform(backing, lambda n: F.coalesce(reason_codes(n["reason"], declared), F.array().cast("array<string>"))))))
    return F.when(decision.isin("block", "review") & (F.size(codes) > 0), codes)


def disposition(codes: Column, rules: dict[str, str]) -> Column:
    """What the categories' rules ask for: an immediate disable beats a notice only; empty if neither."""
    of = lambda what: F.arrays_overlap(codes, F.array(*[F.lit(k) for k, v in sorted(rules.items()) if v == what] or [F.lit("")]))
    return F.when(of(IMMEDIATE), IMMEDIATE).when(of(NOTICE_ONLY), NOTICE_ONLY).otherwise("")


def effective_mode(mode: Column, escalated: Column) -> Column:
    return F.when((mode == "async") & escalated, "blocking").otherwise(mode)


def auth_failure(code: Column, message: Column) -> Column:
    m = F.upper(F.coalesce(message, F.lit("")))
    return m.contains("HTTP 401") | m.contains("HTTP 403") | m.contains("INVALID_API_KEY") | F.coalesce(code, F.lit("")).contains("unauthorized")


def evaluation_delay_s(attempts: Column) -> Column:
    return attempts * attempts


def auto_retry_minutes(count: Column) -> Column:
    return F.when(count <= 0, 1).when(count == 1, 5).otherwise(15)


def notification_delay_s(attempts: Column) -> Column:
    return F.pow(F.lit(2.0), F.least(attempts, F.lit(8))).cast("long")


def cooldown_s(opened: Column) -> Column:
    """15 s, doubled each time the node is opened again, 5 minutes at the most."""
    return F.least(F.lit(15.0) * F.pow(F.lit(2.0), opened - 1), F.lit(300.0)).cast("long")


def quota_failure(status: Column) -> Column:
    return F.when(status.isin(401, 403), "pause").when(status == 404, "hint").otherwise("retry")


def monitor_problems(account: dict[str, Column]) -> Column:
    """The names of the failed checks, in their order. account: name of the check to whether it holds."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in account.items()]))
