"""The pipeline's stages, each against a brute-force version on its own input, and run()."""

from __future__ import annotations

import random

import pytest

from tests.llm.test_corpus import brute_groups

cp = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from modlens.llm.common import stage

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in cp.STAGES:
        made = stage(f(spark, docs, SF), name)
        out.append((name, docs, made))
        docs = made
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_passages", "source_mix"]
    assert all(tuple(made.columns) == cp.COLUMNS for _, _, made in stages[:-1])


def test_near_duplicates_keep_one_of_a_group(stages):
    _, docs, made = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {d for d, _, c in brute_groups(rows, 5, 80) if d == c}
    assert {r["doc_id"] for r in made.select("doc_id").collect()} == want


def test_passages_are_cut(stages):
    from modlens.llm.dedup_spans import PASSAGE as w

    _, docs, made = stages[2]
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, made))
    seen: dict[bytes, int] = {}
    raw = {d: (t or "").encode() for d, t in before.items()}
    for b in raw.values():
        for i in range(len(b) - w + 1):
            seen[b[i : i + w]] = seen.get(b[i : i + w], 0) + 1
    for d, b in raw.items():
        gone = set()
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone.update(range(i, i + w))
        assert after[d].encode() == bytes(c for i, c in enumerate(b) if i not in gone).decode("utf-8", "ignore").encode()


def test_leaks_go(stages, spark):
    _, docs, made = stages[3]
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in made.collect()}
    holds = {r["doc_id"] for r in docs.collect() if any(i in " ".join((r["text"] or "").lower().split()) for i in items)}
    assert holds <= gone and len(gone) <= len(holds) + 3


def test_mix_emits_copies(stages):
    _, docs, made = stages[4]
    ids = {r["doc_id"] for r in docs.collect()}
    rows = made.collect()
    assert {r["doc_id"] for r in rows} <= ids and max(r["copy_index"] for r in rows) <= 1


def test_run_is_the_same_twice(spark):
    a, b = (sorted((r["doc_id"], r["copy_index"]) for r in cp.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_stages_take_odd_tables(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)), None, None, None) for i in range(5)] + [(None, None, None, None, None), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS key", "2 AS score")
    for _, f in cp.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() > 0
    for _, f in cp.STAGES:
        assert f(spark, docs.select(*cp.COLUMNS).limit(0), SF).count() == 0
