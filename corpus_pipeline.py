"""A corpus in five stages: toxicity, near-duplicates, repeated passages, benchmark passages, source mix.

Every stage gets the table of documents that the one before it has written, and returns a table with the same columns;
the last one adds how often each document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modlens.llm import decontamination, dedup_spans, mixing, neardup, toxicity
from modlens.llm.common import read, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3. Null and empty texts score as the model's bias says; repeated rows go or
    stay together; an empty table stays empty. Here, as in all stages, columns besides COLUMNS are dropped."""
    return toxicity.reject_toxic(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles: the smallest id, a null one
    only if all are. Null and empty texts are linked with nothing; repeated rows are one group; an empty table stays empty."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of strings of 280 bytes, about fifty words, that start at two places or more; n_chars follows the
    text. Null texts stay null, with their n_chars; shorter ones stay as they are; repeated rows lose all that they share."""
    out = dedup_spans.without_repeats(docs.select(*COLUMNS))
    return out.selectExpr("doc_id", "text", "lang", "source", "coalesce(cast(length(text) as bigint), n_chars) AS n_chars")


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts stay; repeated rows go or stay together; with an empty
    benchmark all stay."""
    return decontamination.without_passages(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with copy_index from 0; sizes and targets are those of its own input. A
    null source is a source; documents without words aren't taken; repeated rows are mixed alike."""
    return mixing.emit_copies(mixing.mix_sources(docs, keep=("text", "lang", "n_chars"))).select("doc_id", "text", "lang", "source", "n_chars", "copy_index")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_passages", reject_leaks),
    ("source_mix", mix),
]

#: Learned scores, links and suffix arrays aren't for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
