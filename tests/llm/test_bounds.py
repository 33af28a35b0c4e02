"""Bounds of what is collected, exceeded on purpose, and what a cluster without a shared folder gets."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from modlens.llm import common, ctw


@pytest.mark.parametrize("count", ["2000000", "id", "5", "1 + id % 3"])
def test_hot_table_is_bounded(spark, count):
    values = spark.range(5000).selectExpr("id AS key", "cast(id AS double) AS value", f"cast({count} AS long) AS all_n")
    seen = []

    class Kept(ctw.Hot):
        def __init__(self, keys, *rest):
            seen.append(len(keys))
            super().__init__(keys, *rest)

    hot, ctw.Hot = ctw.Hot, Kept
    try:
        ctw.hot_table(values, 1000)
        ctw.hot_table(values, 10_000)
        ctw.hot_table(values.limit(0), 1000)
    finally:
        ctw.Hot = hot
    assert 700 < seen[0] <= 1100 and seen[1:] == [5000, 0]


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
