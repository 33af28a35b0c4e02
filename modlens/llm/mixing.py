"""Mixing sources to target weights, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.llm.common import WORD, read, stage


def _unit(seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the id only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """A row for each source: source, source_size, target.

    Filling by weight up to a cap: in the order of cap / weight, a source is full when its part, by weight, of what is
    left would reach its cap; all others get the same amount for each unit of weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))})
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(onward))
    by = by.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # the first source that isn't full has the level of all that follow it
    first = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * first).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """How often each document is taken so that the sources' words come near their targets.

    Columns: doc_id, size (words of the text), source_size, target, rate, copies, taken, source, and those named in keep.
    A document gets floor(rate) copies and one more with the probability of the fraction, from a hash of the seed and
    doc_id, so reruns agree and repeated rows of an id go together. Sources get the weights by turns in code point
    order, null last; targets share `share` of all words and stop at `most` times their source's.
    A null text has size 0; a source without words has target 0 and rate 0; a null doc_id is hashed as "null".
    An empty table gives an empty table. Other columns are ignored.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    # the words are counted once and the counts read twice; with the texts to carry along the count is repeated instead
    sizes = docs.select("doc_id", "source", *keep, words)
    sizes = sizes if keep else stage(sizes, "mix-sizes")
    targets = source_targets(sizes.select("source", "size"), weights, share, most).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    copies = F.floor("rate") + F.when(_unit(seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", rate)
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), "source", *keep)
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as it is taken, with copy_index from 0."""
    return mixed.where("copies > 0").withColumn("copy_index", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))


def op10_mix_sources(spark, sf_dir):
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM by_source
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM by_source) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), fulls AS (SELECT *, cap <= weight * level AS is_full FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * (SELECT arg_min(level, cap / weight) FROM fulls WHERE NOT is_full) END AS target FROM fulls
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0 END AS rate
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
