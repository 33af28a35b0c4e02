"""Language identification by prediction by partial matching with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import U, append_columns, byte_chunks, fold, free_name, read, tidy
from modlens.llm.labelled import share

ORDER = 4


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the `order` bytes before it in its row (0 where there is none), the newest in the low bits."""
    out = data.astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[: max(0, len(data) - k)]
        before[at < k] = 0
        out |= before << U(8 * k)
    return out


class Order:
    """The contexts of one length: (context, byte) counts, and each context's escape and exclusion sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, first = np.unique(keys >> U(8), return_index=True)
        self.total = np.add.reduceat(counts, first) if len(keys) else np.zeros(0)
        self.distinct = np.diff(np.append(first, len(keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        return _find(self.keys, keys)

    def context(self, contexts: np.ndarray) -> np.ndarray:
        return _find(self.contexts, contexts)


def _find(there: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions in the sorted array, -1 where missing."""
    at = np.minimum(np.searchsorted(there, keys), max(len(there) - 1, 0))
    return np.where(there[at] == keys, at, -1) if len(there) else np.full(len(keys), -1)


class Ppm:
    """A language's byte context tree, orders 0 to ORDER, with method C escapes and exclusion."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        """keys: distinct grams() values of the training bytes; counts: how often each occurs."""
        self.orders: list[Order] = []
        for k in range(order + 1):
            short, inverse = np.unique(keys & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.orders.append(Order(short, np.bincount(inverse, counts, len(short))))
        # What the next longer context has seen is excluded here: the sum of those bytes' counts and their number.
        self.excluded: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order):
            long, short = self.orders[k + 1], self.orders[k]
            own = short.counts[short.find(long.keys & U((1 << 8 * (k + 1)) - 1))] if len(long.keys) else np.zeros(0)
            owner = long.context(long.keys >> U(8))
            self.excluded.append((np.bincount(owner, own, len(long.contexts)), np.bincount(owner, minlength=len(long.contexts))))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The exact code length of each gram's last byte after the bytes before it."""
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        above = np.full(len(keys), -1)  # the last longer context that exists
        for k in range(len(self.orders) - 1, -1, -1):
            o = self.orders[k]
            short = keys & U((1 << 8 * (k + 1)) - 1)
            ctx, hit = o.context(short >> U(8)), o.find(short)
            total, distinct = np.zeros(len(keys)), np.zeros(len(keys))
            there = open_ & (ctx >= 0)
            total[there], distinct[there] = o.total[ctx[there]], o.distinct[ctx[there]]
            if k < len(self.orders) - 1:
                mass, number = self.excluded[k]
                cut = there & (above >= 0)
                total[cut] -= mass[above[cut]]
                distinct[cut] -= number[above[cut]]
            coded = there & (hit >= 0)
            out[coded] -= np.log2(o.counts[hit[coded]] / (total[coded] + distinct[coded]))
            # where all that this context has seen is excluded, an escape is certain
            escape = there & ~coded & (distinct > 0)
            out[escape] -= np.log2(distinct[escape] / (total[escape] + distinct[escape]))
            open_ &= ~coded
            above = np.where(there, ctx, -1)
        seen = self.orders[0].distinct[0] if len(self.orders[0].distinct) else 0
        out[open_] += np.log2(max(1, 256 - seen))
        return out


class Coder:
    """Code lengths under all languages. Each distinct gram is worked out once and kept in a table of fixed size."""

    def __init__(self, models: list[Ppm], bits: int = 19):
        self.models, self.shift = models, U(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros((1 << bits, len(models)), np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != keys)
        out = self.values[slot]
        if len(miss):
            new, inverse = np.unique(keys[miss], return_inverse=True)
            made = np.stack([m.bits(new) for m in self.models], axis=1).astype(np.float32)
            at = ((new * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
            _, last = np.unique(at[::-1], return_index=True)  # of the new grams of one slot, one stays
            last = len(at) - 1 - last
            self.keys[at[last]], self.values[at[last]] = new[last], made[last]
            out[miss] = made[inverse]
        return out


def fit_languages(docs: DataFrame, learn: Column, bound: int, size: int) -> dict[str, Ppm]:
    """A tree for each language, from about `bound` of its documents where `learn` holds, or all if there are fewer, and
    about `size` bytes of them at most, taken by a hash of doc_id and text; whole texts count. Bytes are counted in Spark;
    both bounds are for each language, so one of few documents is learned from all of them, and a tree has at most
    `size` grams whatever the texts' lengths."""
    known = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(bound)) / F.count(F.lit(1)), F.lit(float(size)) / F.greatest(F.lit(1), F.sum(F.octet_length("text")))).alias("rate"))
    sample = known.join(F.broadcast(sizes), "lang").where(share("doc_id", "text") < F.col("rate")).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lo, hi, data, ends in byte_chunks(pc.utf8_lower(b.column("text"))):
                keys, per = grams(data, ends), np.diff(ends)
                for lang in sorted(set(langs[lo:hi])):
                    k, c = np.unique(keys[np.repeat(langs[lo:hi] == lang, per)], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "gram": pa.array(k.astype(np.int64)), "n": pa.array(c.astype(np.int64))})

    rows = sample.mapInArrow(tidy(counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = rows.toArrow().to_pandas()
    return {lang: Ppm(p["gram"].to_numpy().astype(np.uint64), p["n"].to_numpy(float)) for lang, p in sorted(table.groupby("lang"))}


def identify(docs: DataFrame, models: dict[str, Ppm]) -> DataFrame:
    """docs with lang_pred, the language that codes the whole lower-cased text in the fewest bits (of equals the first
    by name), and score, its share of the probability of all, each under a name that no column has. Null texts and those
    without letters: und, score 0."""
    names = sorted(models)
    sent = docs.sparkSession.sparkContext.broadcast([models[n] for n in names])

    def start():
        coder = Coder(sent.value) if names else None

        def made(batch: pa.RecordBatch) -> list[pa.Array]:
            text = batch.column("text")
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
            pred, score = np.full(len(text), "und", object), np.zeros(len(text))
            if coder:
                for lo, hi, data, ends in byte_chunks(pc.utf8_lower(text)):
                    sums = np.zeros((hi - lo, len(names)))
                    if len(data):
                        full = np.flatnonzero(np.diff(ends))
                        sums[full] = np.add.reduceat(coder(grams(data, ends)), ends[:-1][full], axis=0, dtype=np.float64)
                    best = sums.argmin(1)
                    share = 1 / np.exp2(np.maximum(sums.min(1, keepdims=True) - sums, -1000)).sum(1)
                    ok = letters[lo:hi]
                    pred[lo:hi][ok] = np.array(names, object)[best[ok]]
                    score[lo:hi][ok] = share[ok]
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

        return made

    return append_columns(docs, f"`{free_name(docs, 'lang_pred')}` string, `{free_name(docs, 'score')}` double", start)


def op7_language(spark, sf_dir, bound: int = 4_000, size: int = 16 << 20):
    """doc_id, held_out, lang_pred, score of every document. Learns from about `bound` documents of each language that
    aren't held out, of about `size` bytes at most. Very long texts are read whole; of languages that code a text in
    equally few bits, the first by name is predicted. A null id is held out; without any document to learn from, every language is und; other columns are
    ignored; repeated rows are predicted alike; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = fit_languages(docs, F.coalesce(fold("doc_id", 5) != 0, F.lit(False)), bound, size)
    return identify(docs.select("doc_id", "text"), models).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
