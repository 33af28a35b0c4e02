"""Exact percentiles and batch numbers that no single task makes, against numpy and plain loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens.operators import quantiles, relational

POINTS = (0.0, 0.05, 0.5, 0.95, 1.0)


@pytest.mark.parametrize("ranges", [2, 7, 4096])
def test_percentiles(spark, ranges):
    rng = random.Random(4)
    sets = {
        "whole": [rng.randrange(-50, 1000) for _ in range(500)],
        "equal": [3.5] * 100,
        "hot": [1.0] * 300 + [rng.random() for _ in range(50)],
        "steep": [(-2.0) ** k for k in range(60)],
        "huge": [-1.7e308, 1.7e308, 0.0, 1e-300],
        "one": [42],
        "none": [],
    }
    n = max(map(len, sets.values()))
    rows = [tuple(None if i >= len(v) else float(v[i]) for v in sets.values()) for i in range(n)] + [(float("nan"),) * len(sets)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in sets))
    got = quantiles.exact_percentiles(df, {k: F.col(k) for k in sets}, POINTS, ranges)
    for k, v in sets.items():
        assert got[k]["n"] == len(v)
        for p in POINTS:
            want = None
            if v:
                s, at = sorted(map(float, v)), p * (len(v) - 1)
                low, high = s[math.floor(at)], s[math.ceil(at)]
                want = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
            assert got[k][p] == (want if want is None else pytest.approx(want, rel=1e-12))
    assert got["whole"]["mean"] == pytest.approx(np.mean(sets["whole"])) and got["whole"]["most"] == max(sets["whole"])


def test_percentiles_refuse_infinity(spark):
    with pytest.raises(ValueError, match="infinite"):
        quantiles.exact_percentiles(spark.createDataFrame([(float("inf"),)], "v double"), {"v": F.col("v")}, (0.5,))


@pytest.mark.parametrize("rows", [1, 7, 50, 1 << 20])
def test_batches(spark, rows):
    rng = random.Random(2)
    data = [(rng.choice([1, 1, 1, 2, None]), i) for i in rng.sample(range(-500, 5000), 300)]
    df = spark.createDataFrame(data, "g int, id long").withColumn("note", F.lit("x"))
    got = relational.numbered_batches(df, "g", "id", 10, rows=rows)
    assert got.columns == ["g", "id", "note", "batch"]
    groups = defaultdict(list)
    for g, i in data:
        groups[g].append(i)
    want = {(g, i): k // 10 for g, v in groups.items() for k, i in enumerate(sorted(v))}
    assert {(r["g"], r["id"]): r["batch"] for r in got.collect()} == want
    assert relational.numbered_batches(df.limit(0), "g", "id", 10, rows=rows).count() == 0


def test_batches_with_nulls_and_ties(spark):
    data = [(1, None)] * 25 + [(1, 5)] * 25 + [(1, 7)]
    got = relational.numbered_batches(spark.createDataFrame(data, "g int, id long"), "g", "id", 10, rows=10).collect()
    by = defaultdict(list)
    for r in got:
        by[r["id"]].append(r["batch"])
    assert sorted(by[None]) == [0] * 10 + [1] * 10 + [2] * 5 and sorted(by[5]) == [2] * 5 + [3] * 10 + [4] * 10 and by[7] == [5]
