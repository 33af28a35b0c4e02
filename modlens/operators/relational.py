"""Joins, rankings and row generators that several reports share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in the order. Spark keeps only so many of a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= keep).drop("rank_")


def max_per(df: DataFrame, keys: Sequence[str], value: str, by: str, alias: str) -> DataFrame:
    """The value of each key's row with the greatest `by`: an aggregate, so a hot key is summed up before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, by).alias(alias))


def flag(df: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """df with a boolean: whether its column is among the keys' values."""
    k = keys.select(F.col(column).alias("key_")).distinct()
    return df.join(k, F.col(column) == F.col("key_"), "left").withColumn(name, F.col("key_").isNotNull()).drop("key_")


def unreferenced(df: DataFrame, column: str, *others: DataFrame) -> DataFrame:
    """Rows of df whose column none of the others has."""
    for o in others:
        df = df.join(o.select(F.col(o.columns[0]).alias("key_")).where("key_ IS NOT NULL").distinct(), F.col(column) == F.col("key_"), "left_anti")
    return df


def reusable_review(wanted: DataFrame, reviews: DataFrame) -> DataFrame:
    """As-of lookup: for each row (hash_key, eval_key, reuse_after) the newest reusable review that isn't older.

    The newest review of a key is summed up first (a struct's maximum), so each key sends one row; if that is too old,
    all are.
    """
    newest = reviews.where("reusable").groupBy(F.col("hash_key").alias("h"), F.col("eval_key").alias("e")).agg(F.max(F.struct("created_at", F.col("id").alias("review_id"), F.col("score").alias("review_score"))).alias("newest"))
    ok = (F.col("hash_key") == F.col("h")) & (F.col("eval_key") == F.col("e")) & (F.col("newest.created_at") >= F.col("reuse_after"))
    return wanted.join(newest, ok, "left").select(*wanted.columns, F.col("newest.review_id").alias("review_id"), F.col("newest.review_score").alias("review_score"))


def numbered_batches(df: DataFrame, group: str, order: str, size: int, rows: int = 1 << 20) -> DataFrame:
    """batch: rows of each group numbered in the order of a numeric column, null first, and cut into batches.

    The order's values are cut into ranges of about `rows` rows, from a sketch of its percentiles. A row's number is its
    place in its group's part of a range, and how many rows of the group lie in the ranges before: no task sorts a whole
    group, and the sums are joined by (group, range), each one row.
    """
    points = [i / 1024 for i in range(1, 1024)]
    n, at = df.agg(F.count(F.lit(1)), F.percentile_approx(order, points, 10_000)).first()
    every = max(1, -(-1024 * rows // max(n, 1)))
    cuts = sorted({x for x in (at or [])[every - 1 :: every]})
    if not cuts:
        return _numbered(df, [group], order).withColumn("batch", F.floor((F.col("place_") - 1) / size)).drop("place_")
    ranged = df.withColumn("range_", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(order))))
    sums = ranged.groupBy(F.col(group).alias("group_"), F.col("range_").alias("of_")).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("group_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group_", "of_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    placed = _numbered(ranged, [group, "range_"], order).join(sums, F.col(group).eqNullSafe(F.col("group_")) & (F.col("range_") == F.col("of_")))
    return placed.withColumn("batch", F.floor((F.col("before_") + F.col("place_") - 1) / size)).select(*df.columns, "batch")


def _numbered(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 200) -> DataFrame:
    number, size = max(1, number), min(max(1, size), most)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and those rows whose key it has not: one of each new key."""
    new = rows.dropDuplicates([key]).join(table.select(F.col(key).alias("key_")), F.col(key) == F.col("key_"), "left_anti")
    return table.unionByName(new)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with the rows in place of those of equal keys."""
    marked = rows.select(*[F.col(k).alias(f"{k}_") for k in keys]).distinct()
    kept = table.join(marked, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left_anti")
    return kept.unionByName(rows)


def zip_insert(df: DataFrame, **arrays: str) -> DataFrame:
    """A row of each place of arrays of one length: name = column."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.withColumn("z_", F.explode(zipped)).select(*[c for c in df.columns if c not in arrays.values()], *[F.col(f"z_.{n}").alias(n) for n in arrays])
