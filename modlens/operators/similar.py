"""SimHash neighbours: a Hamming self-join without comparing all pairs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions.text import hamming

MOST = 3  # different bits
BLOCKS = MOST + 3  # however the bits fall, three blocks are equal: keys of about 32 bits, in 20 tables
WIDTHS = [64 * (i + 1) // BLOCKS - 64 * i // BLOCKS for i in range(BLOCKS)]


_SIGNED = lambda m: m - (1 << 64) if m >> 63 else m
_MASKS = [_SIGNED(((1 << w) - 1) << sum(WIDTHS[:i])) for i, w in enumerate(WIDTHS)]


def _keys(simhash: str) -> Column:
    """For each choice of three blocks their bits, with zeros elsewhere."""
    return F.array(*[F.col(simhash).bitwiseAND(F.lit(x | y | z).cast("long")) for x, y, z in combinations(_MASKS, 3)])


def similar_classes(left: DataFrame, right: DataFrame, most: int = MOST) -> DataFrame:
    """ha, hb, distance of the distinct simhashes of left and right with at most `most` different bits, equal ones included.

    With `most` up to MOST, three of the BLOCKS parts of two such hashes are equal, so the join on (choice, bits) misses none. Two hashes
    meet once for each choice of equal parts; only the choice of their first three gives a row, so that pairs needn't be gathered to be
    told apart. Both sides have 20 rows a hash, which Spark's sizes don't tell: they are dealt out and merged, never broadcast.
    """
    if most > MOST:
        raise ValueError("more different bits than the tables find")

    def banded(df: DataFrame, name: str) -> DataFrame:
        hashes = df.where("simhash IS NOT NULL").select(F.col("simhash").alias(name)).distinct()
        return hashes.select(name, F.posexplode(_keys(name)).alias(f"{name}_band", f"{name}_bits"))

    a, b = banded(left, "ha"), banded(right, "hb")
    d = hamming(F.col("ha"), F.col("hb"))
    met = a.join(b.hint("merge"), (F.col("ha_band") == F.col("hb_band")) & (F.col("ha_bits") == F.col("hb_bits")) & (d <= most) & (F.col("ha_band") == _first_choice(F.col("ha").bitwiseXOR(F.col("hb")))))
    return met.select("ha", "hb", d.cast("int").alias("distance"))


def _first_choice(different: Column) -> Column:
    """The first choice of three blocks in which no different bit lies: that of the first three such blocks."""
    equal = [(different.bitwiseAND(F.lit(m)) == 0).cast("int") for m in _MASKS]
    upto = [sum(equal[1 : k + 1], equal[0]) for k in range(BLOCKS)]
    # whether block k is among the first three, as bit k; choices by their bits
    bits = sum((F.when((equal[k] == 1) & (upto[k] <= 3), 1 << k).otherwise(0) for k in range(1, BLOCKS)), F.when(equal[0] == 1, 1).otherwise(0))
    place = {sum(1 << k for k in c): i for i, c in enumerate(combinations(range(BLOCKS), 3))}
    return F.element_at(F.array(*[F.lit(place.get(m, -1)) for m in range(1 << BLOCKS)]), bits + 1)


def similar_pairs(left: DataFrame, right: DataFrame, most: int = MOST) -> DataFrame:
    """a, b, distance of rows (id, simhash) of left and right with different ids and at most `most` different bits.

    Rows of one hash are one class: classes are joined, then their members are listed, so a hash that many rows share isn't
    compared with itself row by row. Members are hashed, pairs stream past them: pairs are never sorted or held.
    """
    a, b = (df.where("simhash IS NOT NULL").select(F.col("id").alias(k), F.col("simhash").alias(f"s{k}")) for df, k in ((left, "a"), (right, "b")))
    out = similar_classes(left, right, most).join(a.hint("shuffle_hash"), F.col("ha") == F.col("sa"))
    out = out.join(b.hint("shuffle_hash"), F.col("hb") == F.col("sb"))
    return out.where("a <> b").select("a", "b", "distance")


def nearest_before(rows: DataFrame, most: int = MOST) -> DataFrame:
    """For each row (id, simhash) that has a similar one of a smaller id the nearest of those: a, b, distance (least distance, then least a).

    Within a class of equal hashes that is the smallest id, for every member but that one itself. So only smallest ids are looked for among other classes,
    and of all classes at one distance the least id is enough: a group-by without lists finds it right behind the join, and no member meets more than one
    row. Distances are taken within buckets of equal bits, in as many tasks as the session shuffles into, however few bytes the hashes are.
    """
    rows = rows.where("simhash IS NOT NULL")
    spark = rows.sparkSession
    rows = rows.checkpoint() if spark.sparkContext.getCheckpointDir() else rows
    classes = rows.groupBy("simhash").agg(F.min("id").alias("least"))
    tables = classes.select("*", F.posexplode(_keys("simhash")).alias("band", "bits")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "band", "bits")
    a, b = (tables.select("band", "bits", F.col("simhash").alias(f"h{k}"), F.col("least").alias(k)) for k in "ab")
    d = hamming(F.col("ha"), F.col("hb"))
    met = a.join(b.hint("merge"), ["band", "bits"]).where((F.col("a") < F.col("b")) & (d <= most))
    at = [f"at{k}" for k in range(1, most + 1)]
    by = met.groupBy(F.col("b").alias("least")).agg(*[F.min(F.when(d == k, F.col("a"))).alias(c) for k, c in enumerate(at, 1)])
    other = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("distance"), F.col(c).alias("a"))) for k, c in enumerate(at, 1)])
    first = by.select(other.alias("near"), F.col("least").alias("b"))
    later = rows.join(classes, "simhash").where("id > least").select(F.struct(F.lit(0).alias("distance"), F.col("least").alias("a")).alias("near"), F.col("id").alias("b"))
    return first.unionByName(later).select("near.a", "b", "near.distance")
