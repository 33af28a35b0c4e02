"""Exact percentiles by rank selection: no buffer grows with the data."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that an interval is cut into at each pass.
RANGES = 4096


def exact_percentiles(df: DataFrame, columns: Mapping[str, Column], points: Sequence[float], ranges: int = RANGES) -> dict[str, dict]:
    """For each name n, mean, most, and the interpolated percentiles of its column by point; null and NaN are skipped, infinite values end in an error.

    A percentile lies between two ranks. Each pass counts the values of the interval that holds a rank by equal ranges, and
    keeps the range with the rank, between its least and greatest value; it ends when those are one. A pass is one
    aggregate with a group for each rank and range, at most 2 * len(columns) * len(points) * ranges rows, however many
    values there are; all ranks share it. Whole numbers up to a billion take three passes.
    """
    names = list(columns)
    values = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), columns[n].cast("double").alias("v")) for n in names])).alias("x")).select("x.*").where("v IS NOT NULL AND NOT isnan(v)")
    found = values.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
    out = {n: {"n": 0, "mean": None, "most": None} | dict.fromkeys(points) for n in names}
    if any(math.isinf(r["least"]) or math.isinf(r["most"]) for r in found):
        raise ValueError("no percentile between infinite values")
    # (name, rank): least, greatest, rank within the interval
    looked = {}
    for r in found:
        out[r["name"]] |= {"n": r["n"], "mean": r["mean"], "most": r["most"]}
        for p in points:
            at = p * (r["n"] - 1)
            for k in {math.floor(at), math.ceil(at)}:
                looked[r["name"], k] = (r["least"], r["most"], k)
    while open_ := {k: v for k, v in looked.items() if v[0] < v[1]}:
        asked = [F.when((F.col("name") == name) & F.col("v").between(lo, hi), F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col("v") / hi - lo / hi if hi - lo == math.inf else (F.col("v") - lo) / (hi - lo)) * ranges), F.lit(ranges - 1)).alias("cell"))) for i, ((name, _), (lo, hi, _)) in enumerate(open_.items())]
        cells = values.select("v", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        by: dict[int, list] = {}
        for r in cells.collect():
            by.setdefault(r["i"], []).append((r["least"], r["most"], r["n"]))
        for i, key in enumerate(open_):
            rank = open_[key][2]
            for least, most, n in sorted(by[i]):
                if rank < n:
                    looked[key] = (least, most, rank)
                    break
                rank -= n
    for r in found:
        for p in points:
            at = p * (r["n"] - 1)
            low, high = looked[r["name"], math.floor(at)][0], looked[r["name"], math.ceil(at)][0]
            # weighed as Spark's own percentile does
            out[r["name"]][p] = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
    return out
