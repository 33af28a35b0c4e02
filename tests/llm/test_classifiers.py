"""Toxicity, quality, language: held-out accuracy on the test tables, exact code lengths, edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from modlens.llm import language, quality, toxicity
from modlens.llm.labelled import sample_labelled

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (None, "some text"), (2, ""), (3, "   "), (4, "word " * 20000), (5, "same same same"), (5, "same same same")]


def learned(rows, label, m, r, held):
    return [x for x in rows if (zlib.crc32(str(x["doc_id"]).encode()) % m == r) == held]


@pytest.fixture(scope="module")
def labelled(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_toxicity_tells_held_out_documents_apart(spark, labelled):
    rows = toxicity.op1_toxicity(spark, SF).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labelled]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["predicted"] == labelled[r["doc_id"]]["toxic"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_tells_held_out_documents_apart(spark, labelled):
    rows = quality.op2_quality(spark, SF).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labelled]
    assert np.mean([r["predicted"] == labelled[r["doc_id"]]["quality"] for r in held]) > 0.9


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    fm = toxicity.FactorizationMachine(30)
    fm.b, fm.w, fm.v = -0.3, rng.normal(size=30).astype(np.float32), rng.normal(size=(30, 8)).astype(np.float32)
    rows = [sorted(rng.choice(30, k, replace=False)) for k in (0, 1, 2, 7, 30, 0)]
    for row, got in zip(rows, fm.scores(rows)):
        z = fm.b + sum(float(fm.w[i]) for i in row) + sum(float(fm.v[i] @ fm.v[j]) for i in row for j in row if i < j)
        assert got == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-4)


def test_toxicity_learns_what_only_pairs_tell(spark):
    """Each word alone tells nothing: a document is toxic if insult and group are both there or both absent."""
    rng = np.random.default_rng(1)
    rows, other = [], [f"word{i}x" for i in range(400)]
    for i in range(3000):
        insult, group = i % 2, i // 2 % 2
        words = [*rng.choice(other, 30), "idiotic" if insult else "fellow", "groupies" if group else "tables"]
        rows.append((i, " ".join(rng.permutation(words)), int(insult == group)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    terms, fm = toxicity.train_on(docs, labels, 20_000)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, terms, fm).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 500 and np.mean([(got[i] >= 0.5) == rows[i][2] for i in held]) > 0.97


def test_samples_stay_within_their_bounds(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('text ', id, repeat(' long', 2000)) AS text").union(spark.range(600).selectExpr("7", "concat('again ', id, repeat(' long', 2000))"))
    labels = spark.range(600).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    learn = F.col("label_id").isNotNull()
    assert 60 < labelled_rows(docs, labels, learn, 100, 1 << 30) < 140
    assert sample_labelled(docs, labels, "toxic", learn, 10_000, 1 << 20).agg(F.sum(F.octet_length("text"))).first()[0] < 2 << 20


def labelled_rows(docs, labels, learn, bound, size):
    return sample_labelled(docs.where("text LIKE 'text%'"), labels, "toxic", learn, bound, size).count()


def test_quality_of_string_ids_and_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(f"id{i}", "plain prose of words" if i % 2 else "X!! Y!! Z!!", 1.0) for i in range(80)], "doc_id string, text string, score double")
    labels = docs.selectExpr("doc_id", "cast(substr(doc_id, 3) AS int) % 2 AS quality")
    for name, d in (("some", docs), ("none", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = quality.op2_quality(spark, f"{tmp_path}/some").collect()
    assert len(rows) == 80 and np.mean([r["predicted"] == int(r["doc_id"][2:]) % 2 for r in rows]) > 0.9
    assert quality.op2_quality(spark, f"{tmp_path}/none").count() == 0
    model = quality.SubwordModel()
    assert quality.score_quality(docs, model).columns == ["doc_id", "text", "score", "score_"]


def test_word_cache_scores_as_the_mean_of_subword_vectors(spark):
    model = quality.SubwordModel()
    texts = ["one two two three", "été été", "a", "", "x " * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    for i, t in enumerate(texts):
        words = quality.tokens(t)
        vectors = [model.e[quality.subwords(w)].astype(np.float64).mean(0) for w in words]
        h = np.mean(vectors, axis=0) if words else np.zeros(model.e.shape[1])
        z = model.out.astype(np.float64) @ h + model.bias
        assert got[i] == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-6)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    train = spark.createDataFrame([(i, "nice words here" if i % 2 else "vile words here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 1) for i in range(40)] + [(None, 1, 1), (7, None, None)], "doc_id long, toxic int, quality int")
    rows, fm = toxicity.train_on(train, labels, 1000)
    got = toxicity.score_toxicity(docs, rows, fm).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), rows, fm).count() == 0
    odd = train.withColumnRenamed("text", "TEXT0").selectExpr("doc_id", "TEXT0 AS text", "1 AS score", "2 AS toxic_score", "3 AS y")
    kept = toxicity.reject_toxic(odd, labels)
    assert kept.columns == odd.columns and 0 < kept.count() < 40
    none = toxicity.fit_toxicity(train.selectExpr("text", "1 AS y", "cast(0 AS double) AS at").limit(0))
    assert none[0] == {}


def test_quality_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    sample = spark.createDataFrame([(i, "plain prose of words" if i % 2 else "X!! Y!! Z!!", i % 2) for i in range(60)], "doc_id long, text string, y int").withColumn("at", F.rand(1))
    model = quality.fit_quality(sample)
    got = {r["text"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert got[None] == got[""] == got["   "] and all(0 <= s <= 1 for s in got.values())
    assert quality.fit_quality(sample.limit(0)).word_value().shape == (1 << quality.BITS,)


def brute_ppm(train: list[bytes], text: bytes, order: int) -> float:
    """Method C with exclusion, a byte at a time."""
    seen: dict[bytes, Counter] = defaultdict(Counter)
    for t in train:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k : i]][t[i]] += 1
    bits, padded = 0.0, b"\0" * order + text
    for i in range(order, len(padded)):
        out: set[int] = set()
        for k in range(order, -1, -1):
            c = {b: n for b, n in seen.get(padded[i - k : i], {}).items() if b not in out}
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if padded[i] in c:
                bits -= math.log2(c[padded[i]] / total)
                break
            bits -= math.log2(len(c) / total)
            out |= set(c)
        else:
            bits += math.log2(256 - len(out))
    return bits


@pytest.mark.parametrize("text", ["the cat", "then that thing", "zebra", "", "été"])
def test_code_lengths_are_exact(text):
    train = [b"the cat sat on the mat", b"that hat then"]
    keys, counts = [], []
    for t in train:
        g = language.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        keys.append(g)
    k, n = np.unique(np.concatenate(keys), return_counts=True)
    model = language.Ppm(k, n.astype(float))
    raw = text.encode()
    got = model.bits(language.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))).sum()
    assert got == pytest.approx(brute_ppm(train, raw, language.ORDER), abs=1e-9)


def test_coder_keeps_values_of_colliding_grams():
    k = np.arange(1, 4000, dtype=np.uint64) * np.uint64(257)
    model = language.Ppm(k, np.ones(len(k)))
    small = language.Coder([model], bits=4)
    for _ in range(3):
        x = np.random.default_rng(2).choice(k, 500)
        assert np.allclose(small(x)[:, 0], model.bits(x), atol=1e-4)


def test_language_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op7_language(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 3 if i % 2 else "der hund und die katze " * 3, "en" if i % 2 else "de") for i in range(30)] + [(40, None, "en"), (41, "x", None), (None, "the", "en")], "doc_id long, text string, lang string")
    models = language.fit_languages(docs, docs["doc_id"].isNotNull(), 1000, 1 << 24)
    assert sorted(models) == ["de", "en"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (5, "der hund " * 30000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(odd, models).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["und", "und", "und", "en", "de"]
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.identify(odd.limit(0), models).count() == 0
