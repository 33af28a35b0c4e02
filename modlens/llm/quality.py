"""Quality: supervised subword embeddings, averaged for each document, with a softmax output."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import append_columns, fold, free_name, give_back, read, stage, unstage
from modlens.llm.labelled import sample_labelled

BITS = 17
SAME = "\x01same"  # stands for a word that repeats the one before it


def subwords(word: str) -> list[int]:
    """Hashes of a word and of its character 3- and 4-grams with the word's borders."""
    if word == SAME:
        return [zlib.crc32(SAME.encode()) >> (32 - BITS)] * 4
    framed = f"<{word}>"
    out = [zlib.crc32(word.encode()) >> (32 - BITS)]
    for k in (3, 4):
        out += [zlib.crc32(framed[i : i + k].encode()) >> (32 - BITS) for i in range(len(framed) - k + 1)]
    return out


def tokens(text: str) -> list[str]:
    words = text.split()
    return words + [SAME] * sum(a == b for a, b in zip(words, words[1:]))


class SubwordModel:
    """A document's vector is the mean over its words of the means of their subwords' vectors; a softmax of it gives the classes."""

    def __init__(self, dim: int = 10, classes: int = 2, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
        self.out, self.bias = rng.normal(0, 0.3, (classes, dim)).astype(np.float32), np.zeros(classes, np.float32)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, rate: float = 1.0, seed: int = 3) -> SubwordModel:
        """Stochastic gradient descent, a document (subword ids, weights that add to 1) at a time, with a falling rate."""
        rng, steps, total = np.random.default_rng(seed), 0, max(1, epochs * len(docs))
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                ids, w = docs[i]
                lr = rate * (1 - steps / total)
                steps += 1
                v = self.e[ids]
                h = w @ v
                g = self.proba(h)
                g[y[i]] -= 1
                back = g @ self.out
                # a row's share of the mean is small, so its step is scaled by the share's root
                self.e[ids] -= lr * np.sqrt(w)[:, None] * back[None, :]
                self.out -= 0.2 * lr * np.outer(g, h)
                self.bias -= 0.2 * lr * g
        return self

    def proba(self, h: np.ndarray) -> np.ndarray:
        z = self.out @ h + self.bias
        z = np.exp(z - z.max())
        return (z / z.sum()).astype(np.float32)

    def word_value(self) -> np.ndarray:
        """For two classes all that a subword adds to the difference of the two outputs."""
        return self.e.astype(np.float64) @ (self.out[1] - self.out[0]).astype(np.float64)


def document_subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subword ids of a whole text and their weights, which add to 1."""
    weight: dict[int, float] = {}
    counts = Counter(tokens(text))
    n = sum(counts.values())
    for word, c in counts.items():
        ids = subwords(word)
        for t in ids:
            weight[t] = weight.get(t, 0.0) + c / (n * len(ids))
    return np.fromiter(weight, np.int32, len(weight)), np.fromiter(weight.values(), np.float32, len(weight))


def fit_quality(sample: DataFrame) -> SubwordModel:
    """The model, from sample's text, y (0 or 1) and at. Subword ids are made in Spark, a document has 2**BITS at the most, and the sample's bytes bound what comes to the driver."""

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [document_subwords(t) for t in p["text"]]
            yield pd.DataFrame({"at": p["at"], "y": p["y"].astype("int32"), "ids": [a.astype("<i4").tobytes() for a, _ in got], "w": [b.astype("<f4").tobytes() for _, b in got]})

    held = stage(sample.select("text", "at", "y").mapInPandas(prepared, "at double, y int, ids binary, w binary"), "quality-sample")
    # in the order of `at`, so that the model doesn't depend on how the sample was partitioned
    rows = sorted(((r["at"], r["y"], bytes(r["ids"]), bytes(r["w"])) for r in held.toLocalIterator()), key=lambda r: r[:2])
    unstage(held)
    docs = [(np.frombuffer(a, "<i4"), np.frombuffer(b, "<f4")) for _, _, a, b in rows]
    y = np.array([r[1] for r in rows], np.int64)
    some = [i for i, d in enumerate(docs) if len(d[0])]
    model = SubwordModel().fit([docs[i] for i in some], y[some])
    del rows, docs
    give_back()
    return model


def score_quality(docs: DataFrame, model: SubwordModel, name: str = "score") -> DataFrame:
    """docs with the probability of class 1, under a name that no column has. A null or empty text scores as the outputs' biases say."""
    sent = docs.sparkSession.sparkContext.broadcast((model.word_value(), float(model.bias[1] - model.bias[0])))

    def start():
        value, bias = sent.value
        seen: dict[str, float] = {}

        def of(text: str | None) -> float:
            words = tokens(text or "")
            if len(seen) > 200_000:
                seen.clear()
            for w in set(words).difference(seen):
                ids = subwords(w)
                seen[w] = float(value[ids].sum()) / len(ids)
            h = sum(map(seen.__getitem__, words)) / len(words) if words else 0.0
            return float(1 / (1 + np.exp(-np.clip(h + bias, -40, 40))))

        return lambda batch: [pa.array([of(t.as_py()) for t in batch.column("text")], pa.float64())]

    return append_columns(docs, f"`{free_name(docs, name)}` double", start)


def op2_quality(spark, sf_dir, bound: int = 4_000, size: int = 24 << 20):
    """doc_id, held_out, score, predicted of every document. Learns from a sample of about `bound` labelled rows that
    aren't held out, of about `size` bytes of text at most. A null id is held out; empty texts score as the biases say;
    very long texts are read whole; equal texts score alike, so ties and repeated rows do too; an empty table gives no
    rows; other columns are ignored, whatever their names."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    learn = F.crc32(F.col("label_id").cast("string").cast("binary")) % 3 != 1
    sample = sample_labelled(docs, read(spark, sf_dir, "labels"), "quality", learn, bound, size)
    model = fit_quality(sample)
    unstage(sample)
    return score_quality(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
