"""Toxicity: a factorisation machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import append_columns, fold, free_name, give_back, read, stage, tidy, unstage
from modlens.llm.labelled import sample_labelled

BITS = 20
_EDGE = ".,!?;:\"'()[]{}<>*#%&$|-_/\\…«»“”‘’¡¿"


def terms(word: str) -> list[int]:
    """Hashes of a word (without punctuation around it) and of its first 4, 5 and 6 letters, so inflected forms share terms."""
    word = word.strip(_EDGE)
    if not word:
        return []
    out = [zlib.crc32(word.encode()) >> (32 - BITS)]
    out += [zlib.crc32(f"{word[:k]}\x00{k}".encode()) >> (32 - BITS) for k in (4, 5, 6) if len(word) >= k]
    return out


class TermCache:
    """The model's rows of each word; forgets all when it holds `most` words."""

    def __init__(self, rows: dict[int, int], most: int = 100_000):
        self.rows, self.most, self.seen = rows, most, {}

    def of(self, text: str | None) -> list[int]:
        """The distinct rows of a whole text's terms."""
        seen, found = self.seen, set()
        for w in set((text or "").lower().split()):
            got = seen.get(w)
            if got is None:
                if len(seen) >= self.most:
                    seen.clear()
                got = seen[w] = tuple(self.rows[t] for t in terms(w) if t in self.rows)
            if got:
                found.update(got)
        return sorted(found)


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The sum of each row's values; rows without any give 0."""
    out = np.zeros((len(ptr) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        out[full] = np.add.reduceat(values, ptr[:-1][full], axis=0)
    return out


class FactorizationMachine:
    """score = sigmoid(b + sum of weights + sum over pairs of the products of their factors), for sets of present terms.

    Sets are given as sparse rows: the terms of all, joined, and where each row begins and ends in them.
    """

    def __init__(self, n: int, rank: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v = 0.0, np.zeros(n, np.float32), rng.normal(0, 0.01, (n, rank)).astype(np.float32)

    def raw(self, at: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        v = self.v[at]
        s = _sums(v, ptr)
        return self.b + _sums(self.w[at], ptr) + 0.5 * ((s * s).sum(1) - _sums((v * v).sum(1), ptr))

    def scores(self, rows: list) -> np.ndarray:
        ptr = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
        at = np.concatenate([np.asarray(r, np.int64) for r in rows]) if ptr[-1] else np.zeros(0, np.int64)
        return 1 / (1 + np.exp(-np.clip(self.raw(at, ptr).astype(np.float64), -40, 40)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, pair_rate: float, shrink: tuple[float, float], seed: int = 7) -> FactorizationMachine:
        """Adagrad over batches of up to 64 documents, smaller ones of few documents, in a seeded order. shrink: the slope
        towards zero of each weight and of the length of each term's factors, over an epoch. With a pair_rate of 0
        factors stay as they are."""
        rng, gb = np.random.default_rng(seed), 1e-6
        gw, gv = np.full(len(self.w), 1e-2, np.float32), np.ones(len(self.v), np.float32)
        order, made, batch = rng.permutation(len(rows)), [], min(64, max(1, len(rows) // 50))
        for a in range(0, len(rows), batch):
            ids = order[a : a + batch]
            ptr = np.append(0, np.cumsum([len(rows[i]) for i in ids]))
            at = np.concatenate([rows[i] for i in ids]).astype(np.int32)
            by = np.argsort(at, kind="stable")
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ptr))[by]
            term, first = np.unique(at[by], return_index=True)
            made.append((at, ptr, doc, term, first.astype(np.int32), y[ids]))
        touched = np.maximum(np.bincount(np.concatenate([m[3] for m in made]), minlength=len(self.w)) if made else np.zeros(len(self.w)), 1).astype(np.float32)
        for _ in range(epochs):
            for k in rng.permutation(len(made)):
                at, ptr, doc, term, first, truth = made[k]
                v = self.v[at]
                s = _sums(v, ptr)
                z = self.b + _sums(self.w[at], ptr) + 0.5 * ((s * s).sum(1) - _sums((v * v).sum(1), ptr))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - truth).astype(np.float32)
                gb += float(g.sum()) ** 2
                self.b -= rate * float(g.sum()) / gb**0.5
                if not len(term):
                    continue
                dw = np.add.reduceat(g[doc], first)
                gw[term] += dw * dw
                step = rate / np.sqrt(gw[term])
                w = self.w[term] - step * dw
                self.w[term] = np.sign(w) * np.maximum(np.abs(w) - step * shrink[0] / touched[term], 0)
                if not pair_rate:
                    continue
                dv = np.add.reduceat((g[:, None] * s)[doc], first, axis=0) - self.v[term] * dw[:, None]
                gv[term] += (dv * dv).mean(1)
                step = (pair_rate / np.sqrt(gv[term]))[:, None]
                v = self.v[term] - step * dv
                length = np.sqrt((v * v).sum(1, keepdims=True)) + 1e-12
                self.v[term] = v * np.maximum(1 - step * shrink[1] / touched[term][:, None] / length, 0)
        return self


#: What a weight, and the length of a term's factors, must reach in the first fit to be in the second.
LEAST = (0.2, 0.4)


def fit_sparse(rows: list[np.ndarray], y: np.ndarray, n: int) -> tuple[np.ndarray, FactorizationMachine]:
    """The terms that tell something, alone or in pairs, and a machine of them alone.

    A first fit shrinks towards zero: weights come first, so that factors learn only what no weight tells; all terms may
    have factors, whatever their weights. A second fit, of what has reached LEAST, is nearly free of that shrinking.
    """
    wide = FactorizationMachine(n)
    wide.b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    wide.fit(rows, y, epochs=6, rate=0.3, pair_rate=0.0, shrink=(2.5, 0.0))
    wide.fit(rows, y, epochs=6, rate=0.1, pair_rate=0.02, shrink=(2.5, 10.0))
    wide.w[np.abs(wide.w) < LEAST[0]] = 0
    wide.v[np.sqrt((wide.v**2).sum(1)) < LEAST[1]] = 0
    kept = np.flatnonzero((wide.w != 0) | wide.v.any(1))
    place = np.full(n, -1, np.int32)
    place[kept] = np.arange(len(kept))
    fm = FactorizationMachine(len(kept))
    fm.b, fm.w, fm.v = wide.b, wide.w[kept].copy(), wide.v[kept].copy()
    few = [p[p >= 0] for p in (place[r] for r in rows)]
    return kept, fm.fit(few, y, epochs=10, rate=0.1, pair_rate=0.02, shrink=(0.3, 0.3))


def fit_toxicity(sample: DataFrame, least_docs: int = 3, most_terms: int = 1 << 17) -> tuple[dict[int, int], FactorizationMachine]:
    """The model and its row of each hashed term, from sample's text, y (0 or 1) and at (a number for each row, whose order is that of learning).

    Terms are counted in Spark. The most_terms most frequent ones that least_docs sampled documents or more have are
    learned from, whatever they tell alone, as a term may tell something only with another. A document's terms are at
    most 2**BITS, so the sample's bound bounds what comes to the driver.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({t for w in set(x.lower().split()) for t in terms(w)}) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["at", "y", "terms"])

    held = stage(sample.select("text", "at", "y").mapInArrow(tidy(hashed), "at double, y int, terms array<int>"), "toxic-sample")
    counts = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("t").alias("k")).where(F.col("k") >= least_docs)
    used = np.sort(np.asarray(counts.orderBy(F.desc("k"), "t").limit(most_terms).select("t").toArrow()["t"], dtype=np.int32))
    got = held.toArrow()
    unstage(held)
    y = np.asarray(got["y"], dtype=np.float64)
    if not 0 < y.sum() < len(y):  # nothing to tell apart
        fm = FactorizationMachine(0)
        fm.b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else -2.0
        return {}, fm
    rows = []
    for part in got["terms"].chunks:
        values, ends = np.asarray(part.values), np.asarray(part.offsets)
        for a, b in zip(ends[:-1], ends[1:]):
            x = values[a:b]
            place = np.minimum(np.searchsorted(used, x), max(len(used) - 1, 0))
            rows.append(place[used[place] == x].astype(np.int32) if len(used) else np.zeros(0, np.int32))
    # in the order of `at`, so that the model doesn't depend on how the sample was partitioned
    order = np.lexsort(([len(r) for r in rows], y, np.asarray(got["at"])))
    rows = [rows[i] for i in order]
    del got, part, values
    kept, fm = fit_sparse(rows, y[order], len(used))
    del rows
    give_back()
    return {int(t): i for i, t in enumerate(used[kept])}, fm


def score_toxicity(docs: DataFrame, rows: dict[int, int], fm: FactorizationMachine, name: str = "score") -> DataFrame:
    """docs with a column, from 0 to 1, under a name that no column has. The text is read whole; a null or empty one scores by the bias alone."""
    model = docs.sparkSession.sparkContext.broadcast((rows, fm))

    def start():
        rows, fm = model.value
        cache = TermCache(rows)

        def scored(batch: pa.RecordBatch) -> list[pa.Array]:
            text = batch.column("text")
            out = [fm.scores([cache.of(t.as_py()) for t in text.slice(a, 512)]) for a in range(0, len(text), 512)]
            return [pa.array(np.concatenate(out) if out else np.zeros(0))]

        return scored

    return append_columns(docs, f"`{free_name(docs, name)}` double", start)


def train_on(docs: DataFrame, labels: DataFrame, bound: int, size: int = 24 << 20):
    learn = F.crc32(F.col("label_id").cast("string").cast("binary")) % 4 != 2
    sample = sample_labelled(docs, labels, "toxic", learn, bound, size)
    model = fit_toxicity(sample)
    unstage(sample)
    return model


def op1_toxicity(spark, sf_dir, bound: int = 20_000):
    """doc_id, held_out, score, predicted of every document. Learns from a sample of about `bound` labelled rows that
    aren't held out, of about 24 MB of text at most. A null id is held out; empty texts score as the bias says; very long texts
    are read whole, each term counting once; equal texts score alike, so ties and repeated rows do too; an empty table
    gives no rows; other columns are ignored, whatever their names."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows, fm = train_on(docs, read(spark, sf_dir, "labels"), bound)
    return score_toxicity(docs, rows, fm).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, bound: int = 20_000, limit: float = 0.3) -> DataFrame:
    """docs without those whose score reaches the limit; columns as before."""
    rows, fm = train_on(docs, labels, bound)
    name = free_name(docs, "toxic_score")
    return score_toxicity(docs, rows, fm, name).where(F.col(name) < limit).drop(name)
