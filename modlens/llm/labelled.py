"""A bounded, repeatable sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import stage, unstage


def share(*columns: str) -> Column:
    """A number from 0 to 1 from the hash of a row's columns."""
    return F.pmod(F.xxhash64(F.lit("sample"), *[F.col(c) for c in columns]), F.lit(1 << 30)) / F.lit(float(1 << 30))


def thinned(sample: DataFrame, size: int, tag: str) -> DataFrame:
    """sample (text, at) as a table, without rows beyond a total of about `size` bytes of text; `at` is a row's share()."""
    held = stage(sample, tag)
    total = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= size:
        return held
    out = stage(held.where(F.col("at") < size / total), tag)
    unstage(held)
    return out


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, size: int) -> DataFrame:
    """doc_id, text, y, at of about `bound` labelled documents where `learn` holds, or of all if there are fewer, and of
    fewer still if they exceed about `size` bytes of text. A table in the shared folder; its reader deletes it.

    A label is in the sample if the hash of its id is below bound / number of labels, and a document if that of id and
    text is below size / bytes, so the choice depends on neither order nor partitions. The sampled ids and labels are at
    most about `bound` rows and are broadcast. Ids without a label, null ids and null labels aren't learned from; of
    several labels of an id the largest counts; repeated rows count once.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y")).where(F.col("label_id").isNotNull() & F.col("y").isNotNull())
    known = known.withColumn("learn", learn).where("learn").groupBy("label_id").agg(F.max("y").alias("y"))
    n = known.count()
    chosen = known.where(share("label_id") < min(1.0, bound / max(n, 1)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.dropDuplicates(["doc_id", "text"]).select("doc_id", "text", F.greatest(F.lit(0), F.least(F.lit(1), "y")).alias("y"), share("doc_id", "text").alias("at"))
    return thinned(rows, size, "labelled")
