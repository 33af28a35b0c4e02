"""Retention, erasure, re-audits, replays, votes and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.functions.decisions import classify, severity, target_codes, vote_outcome
from modlens.operators.relational import latest_per, reusable_review, unreferenced
from modlens.plans.stats import node_results
from modlens.sources.tables import Tables

CUT = "timestamp_ntz '1995-06-01'"


def kept_jobs(t: Tables) -> DataFrame:
    """Jobs that outlive the purge: young ones and those at work."""
    return t.jobs.where(F.expr(f"created_at >= {CUT} OR status IN ('queued', 'processing', 'retry')"))


def kept_targets(t: Tables) -> DataFrame:
    """Jobs' ids are hashed, each once, and targets stream past them unsorted."""
    return t.targets.join(kept_jobs(t).select("id").hint("shuffle_hash"), F.col("job_id") == F.col("id"), "left_semi")


def kept_reviews(t: Tables, keep: int = 5) -> DataFrame:
    """Reviews that a kept target refers to, and of the others the newest `keep` of each (hash, evaluation) that are young."""
    held = kept_targets(t).select("review_id").where("review_id IS NOT NULL").hint("shuffle_hash")
    free, used = (t.reviews.join(held, F.col("id") == F.col("review_id"), how) for how in ("left_anti", "left_semi"))
    # a young one has only young ones before it, so the old needn't be ranked
    young = latest_per(free.where(F.expr(f"created_at >= {CUT}")), ["hash_key", "eval_key"], [F.desc("created_at"), F.desc("id")], keep)
    return used.unionByName(young).select("id", "hash_key", "eval_key")


def kept_texts(t: Tables) -> DataFrame:
    """Texts that anything kept refers to; references become distinct hashes where they are read, and are joined once.

    Of kept reviews the texts matter alone: the newest review of a (hash, evaluation) is kept if it is young, and any young one is referred to
    by a kept target or has a newest one beside it. So all hashes of young reviews count, without a ranking, and of old reviews those
    that a kept target refers to.
    """
    targets = kept_targets(t)
    young = F.expr(f"created_at >= {CUT}")
    used = targets.select("review_id").where("review_id IS NOT NULL").hint("shuffle_hash")
    old = t.reviews.where(~young | F.col("created_at").isNull()).join(used, F.col("id") == F.col("review_id"), "left_semi")
    parts = [targets, t.reviews.where(young), old, t.trust, t.breakers]
    refs = reduce(DataFrame.unionByName, [p.select("hash_key").distinct() for p in parts])
    return t.texts.join(refs.where("hash_key IS NOT NULL").distinct(), "hash_key", "left_semi").select("hash_key", "text")


def erased_texts(t: Tables, user_id: int = 7) -> DataFrame:
    """Texts that nothing refers to after a user's jobs are gone."""
    mine = t.jobs.where(F.col("user_id") == user_id).select("id")
    left = t.targets.join(mine, F.col("job_id") == F.col("id"), "left_anti").select("hash_key")
    gone = t.targets.join(mine, F.col("job_id") == F.col("id"), "left_semi").select("hash_key").distinct()
    return unreferenced(gone, "hash_key", left, t.trust, t.breakers)


def reaudit_estimate(t: Tables) -> DataFrame:
    """Distinct untrusted hashes of the present rounds of blocked jobs."""
    jobs = t.jobs.where("decision = 'block'").select("id", "current_round")
    tg = t.targets.join(jobs, (F.col("job_id") == F.col("id")) & (F.col("round") == F.col("current_round")))
    return unreferenced(tg, "hash_key", t.trust).agg(F.countDistinct("hash_key").alias("estimated"), F.countDistinct("job_id").alias("jobs"))


def reaudit_plan(t: Tables, most: int = 200) -> DataFrame:
    """What a re-audit of all failed and queued jobs would do: the first `most` ready ones go, the others are skipped."""
    ready = F.col("status").isin("done", "failed", "skipped")
    jobs = t.jobs.where("decision = 'block' OR status = 'queued'")
    first = jobs.where(ready).orderBy("id").limit(most).select(F.col("id").alias("first_id"))
    jobs = jobs.join(F.broadcast(first), F.col("id") == F.col("first_id"), "left")  # `most` rows at the most
    return jobs.select("id", F.when(~ready, "already_running").when(F.col("first_id").isNull(), "skipped").otherwise("requeued").alias("outcome"))


def next_round(t: Tables) -> DataFrame:
    """The targets that a re-audit of blocked jobs appends."""
    jobs = t.jobs.where("decision = 'block'").select("id", "current_round")
    return t.targets.join(jobs, (F.col("job_id") == F.col("id")) & (F.col("round") == F.col("current_round"))).select("job_id", (F.col("round") + 1).alias("round"), "target_order", "hash_key", "kind")


def reused_reviews(t: Tables) -> DataFrame:
    """For each blocked job the newest reusable review of its hash and evaluation that isn't older than a year before it."""
    wanted = t.jobs.where("decision = 'block'").select("id", (F.col("id") % 400).alias("hash_key"), (F.col("id") % 3).alias("eval_key"), F.expr("created_at - interval 365 days").alias("reuse_after")).withColumnRenamed("id", "job_id")
    return reusable_review(wanted, t.reviews).select("job_id", "review_id", "review_score")


def config_impact(t: Tables) -> DataFrame:
    """Distinct untrusted blocked targets of the last 30 days."""
    jobs = t.jobs.where(F.expr("created_at >= timestamp_ntz '1997-01-01' - interval 30 days AND created_at < timestamp_ntz '1997-01-01'")).select("id")
    tg = t.targets.where("decision = 'block'").join(jobs, F.col("job_id") == F.col("id"), "left_semi")
    return unreferenced(tg, "hash_key", t.trust).agg(F.countDistinct("hash_key").alias("targets"))


def votes(t: Tables, rule: str = "majority_block", review: float = 0.3, block: float = 0.6) -> DataFrame:
    """The verdict on each (job, hash) by its nodes' votes."""
    vote = classify(F.col("confidence") * 10, review * 10, block * 10)
    failed = F.col("status") == "failed"
    skipped = (F.col("line") == 5) & ~failed
    n = lambda c: F.count_if(c)
    by = t.attempts.withColumn("vote", vote).groupBy("job_id", "hash_key").agg(
        n(~failed & ~skipped & (F.col("vote") == "block")).alias("blocks"), n(~failed & ~skipped & (F.col("vote") == "review")).alias("reviews"), n(failed).alias("failures"), n(skipped).alias("skipped"), F.count(F.lit(1)).alias("nodes"), F.max(F.when(~failed & ~skipped, F.col("confidence"))).alias("score"),
    )
    out = vote_outcome(rule, *[F.col(c) for c in ("blocks", "reviews", "failures", "skipped", "nodes")])
    return by.withColumn("o", out).select("job_id", "hash_key", "o.decision", "o.partial", "o.failure", "score")


def round_decision(targets: DataFrame) -> DataFrame:
    """job_id, decision, kind: the most severe target decides, the user target of equals, then the first; without a block
    nothing is decided while a target is open."""
    s = severity(F.col("decision"))
    rank = F.struct(s.alias("s"), (F.col("kind") == "user").alias("u"), (-F.col("target_order")).alias("o"))
    by = targets.groupBy("job_id").agg(F.max(F.struct(rank.alias("rank"), F.col("decision").alias("d"), F.col("kind").alias("k"))).alias("top"), F.count_if(F.col("decision").isNull()).alias("open"))
    settled = (F.col("open") == 0) | (F.col("top.d") == "block")
    return by.select("job_id", F.when(settled, F.col("top.d")).alias("decision"), F.when(settled, F.col("top.k")).alias("kind"))


def job_decisions(t: Tables) -> DataFrame:
    return round_decision(t.targets.groupBy("job_id", "target_order").agg(F.min("kind").alias("kind"), F.max("decision").alias("decision")))


def target_categories(t: Tables, review: float = 0.02, block: float = 0.05) -> DataFrame:
    """Categories of each job's reasons that back its decision."""
    nodes = node_results(t).groupBy("job_id").agg(F.collect_list(F.struct("confidence", "reason", (F.col("status") == "failed").alias("failed"), F.lit(False).alias("skipped"))).alias("nodes"))
    declared = F.array(*[F.lit(f"R0{i}") for i in range(1, 8)])
    jobs = t.jobs.where("decision IS NOT NULL").select("id", "decision").join(nodes, F.col("id") == F.col("job_id"))
    return jobs.select("id", "decision", F.coalesce(F.array_join(target_codes(F.col("nodes"), F.col("decision"), declared, review, block), ","), F.lit("")).alias("codes"))


def vote_classes(df: DataFrame, column: str, by: int, least: int) -> DataFrame:
    """df with (folded, rest), equal for ids whose votes are equal whatever they meet: those with one remainder of 100, as long as
    no sum of `by` times the id and what it meets, `least` or more, is negative; any other id has its own."""
    folded = F.coalesce(F.col(column) * by + least >= 0, F.lit(False))
    return df.withColumns({"folded": folded, "rest": F.when(folded, F.pmod(F.col(column), F.lit(100))).otherwise(F.col(column))})


def policy_replay(t: Tables, of_block: int = 1024, most: int = 1 << 20) -> DataFrame:
    """Each sample scored by each enabled node with a fixed scorer, and the nodes' verdict on it.

    Votes depend on both, but only by the ids' remainders of 100 where no sum of the two is negative; so samples and nodes are classes of
    equal votes, at most 100 of each besides ids far below zero, which are classes of their own. Every class of samples meets every
    class of nodes, which count as many votes as they have nodes, and a sample takes its class's verdict. Classes of nodes come in
    blocks of about of_block, broadcast up to `most` classes; beyond that they are dealt out by Spark.
    """
    samples, nodes = t.samples.select("id", "expected").distinct(), t.nodes.where("enabled").select("model_id")
    least_id, least_node = samples.agg(F.min("id")).first()[0], nodes.agg(F.min("model_id")).first()[0]
    samples = vote_classes(samples, "id", 31, (least_node or 0) * 17)
    nodes = vote_classes(nodes, "model_id", 17, (least_id or 0) * 31).groupBy("folded", "rest").agg(F.min("model_id").alias("model_id"), F.count(F.lit(1)).alias("nodes"))
    n = nodes.count()
    blocks = nodes.groupBy(F.pmod(F.xxhash64("model_id"), F.lit(max(1, -(-n // of_block)))).alias("block")).agg(F.collect_list(F.struct("model_id", "nodes")).alias("ids")).select("ids")
    scored = samples.groupBy("folded", "rest").agg(F.min("id").alias("id")).join(F.broadcast(blocks) if n <= most else blocks, how="cross")
    vote = lambda m: classify(((F.col("id") * 31 + m * 17) % 100) / 100.0, 0.3, 0.6)
    counted = lambda ids: F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x["nodes"])
    votes = lambda v: F.sum(counted(F.filter("ids", lambda x: vote(x["model_id"]) == v)))
    by = scored.groupBy("folded", "rest").agg(votes("block").alias("b"), votes("review").alias("r"), F.sum(counted(F.col("ids"))).alias("n"))
    verdicts = by.select(F.col("folded").alias("f"), F.col("rest").alias("of"), vote_outcome("majority_block", F.col("b"), F.col("r"), F.lit(0), F.lit(0), F.col("n"))["decision"].alias("decision"))
    return samples.join(verdicts, (F.col("folded") == F.col("f")) & F.col("rest").eqNullSafe(F.col("of"))).select("id", "expected", "decision")


def due_jobs(t: Tables, n: int = 50) -> DataFrame:
    """The next jobs of the queue."""
    return t.jobs.where("status IN ('queued', 'retry')").orderBy("created_at", "id").limit(n).select("id", "created_at")
