"""How filters overlap: what each one removes in every order they could be applied in."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import WORD, read, stage

#: The letter of the filter that looks at the whole table; the others look at one text.
COPIES = "E"
#: Null ids take part in no join; they are dealt out over this many keys.
SPREAD = 4096


def text_filters(least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2, signs: str = r"[#$%&*|]") -> dict[str, Column]:
    """Failure conditions of a column `text` that is not null, by letter. Words are split once, for both counts."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < least_words,
        "B": F.lit(100) * distinct < F.lit(distinct_percent) * n,
        "C": F.lit(100) * F.regexp_count("text", F.lit("[A-Z]")) > F.lit(capital_percent) * F.length("text"),
        "D": F.col("text").rlike(signs),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """Documents by part and set of failed filters: part, mask, n, good, toxic.

    Bit i of mask is the i-th filter, the last bit COPIES. A text goes no further than the scan: from there on it is its
    SHA-256, which stands for it in the group-by that finds the smallest doc_id. Hot texts, ids and parts are summed up
    before each shuffle; joins have one row for a key on their right.
    """
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(filters.values())]
    own = F.lit(0)
    for b in bits:
        own = own.bitwiseOR(b)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), own.alias("mask"))
    rows = stage(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of_id"))
    marks = marks.agg(F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic"))
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD))).otherwise(F.lit(0))
    rows = rows.withColumn("salt", salt).join(marks.withColumn("of_salt", F.lit(0).cast("long")), (F.col("doc_id") == F.col("of_id")) & (F.col("salt") == F.col("of_salt")), "left")
    groups = rows.groupBy("part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    groups = groups.agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("of_least"))
    firsts = groups.groupBy(F.col("digest").alias("of_digest")).agg(F.min("least").alias("first"))
    groups = groups.join(firsts, F.col("digest") == F.col("of_digest"))
    passing = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("of_least")).otherwise(F.lit(0))
    copies = F.lit(1 << len(filters))
    both = F.array(F.struct(F.col("mask"), passing.alias("k")), F.struct(F.col("mask").bitwiseOR(copies).alias("mask"), (F.col("n") - passing).alias("k")))
    cells = groups.select("part", "good", "toxic", F.inline(both)).where("k > 0")
    return cells.groupBy("part", "mask").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))


def filter_interactions(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """A row for each part, order of the filters, and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley; numbers are of documents of the part.

    filters: failure conditions over `text` by letter (text_filters() by default); COPIES comes last: a document whose
    text is that of a smaller doc_id, anywhere in the table. A part has at most 2 ** filters cells; the orders are worked
    out on those, so texts are looked at once, whatever the number of orders.

    A null text is empty and a null source the part "", as is an empty one. A null doc_id is larger than any other;
    repeated rows of an id are documents of their own, and none of them is a copy of another. Several labels of an id:
    quality or toxic is 1 if any is. Null labels and null ids in labels say nothing. An empty table gives no rows. Other
    columns are ignored.
    """
    filters = text_filters() if filters is None else filters
    letters = [*filters, COPIES]
    cells = failure_cells(docs, labels, filters).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = cells.select("part", "cells", F.explode(F.array(*[F.lit("".join(x)) for x in permutations(letters)])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit, before = F.lit(0), F.lit(0)
    for i, x in enumerate(letters):
        at = F.instr("filter_order", x)
        bit = bit + F.when(at == F.col("step"), 1 << i).otherwise(0)
        before = before + F.when(at < F.col("step"), 1 << i).otherwise(0)
    return steps.withColumns({"bit": bit, "before": before}).select("part", "filter_order", "step", *_counts(len(letters)))


def _counts(filters: int) -> list[Column]:
    """The numbers of a step, from the column `cells` of its part and its masks `bit` and `before`."""
    bit, before = F.col("bit"), F.col("before")

    def total(test, number=lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(test(c["mask"]), number(c)).otherwise(F.lit(0).cast("long")))

    def has(mask, bits) -> Column:
        return mask.bitwiseAND(bits) != 0

    def goes(mask) -> Column:
        return has(mask, bit) & ~has(mask, before)

    orders = 1
    for i in range(2, filters + 1):
        orders *= i
    return [
        total(lambda m: ~has(m, bit.bitwiseOR(before))).alias("kept"),
        total(goes).alias("removed"),
        total(lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(goes, lambda c: c["good"]).alias("good_lost"),
        total(goes, lambda c: c["toxic"]).alias("toxic_lost"),
        # of a document's failed filters, each is the first in the same number of orders
        total(lambda m: has(m, bit), lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    ]


def op11_filter_audit(spark, sf_dir):
    return filter_interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(m.toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < doc_id OR doc_id IS NULL AND first_id IS NOT NULL THEN 'E' ELSE '' END AS fails
  FROM split LEFT JOIN marks m USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM orders, range(1, 6) r(step)
), seen AS (
  SELECT part, filter_order, step, x, contains(fails, x) AS bad, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone, fails, good, toxic
  FROM failed, steps
), counted AS (
  SELECT part, filter_order, step, x, count(*) FILTER (NOT bad AND NOT gone) AS kept, count(*) FILTER (bad AND NOT gone) AS removed,
    count(*) FILTER (bad AND gone) AS redundant, count(*) FILTER (fails = x) AS unique_fails, count(*) FILTER (bad AND NOT gone AND good) AS good_lost,
    count(*) FILTER (bad AND NOT gone AND toxic) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM counted
"""
