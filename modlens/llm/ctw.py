"""Context-tree weighting: the probability of texts under binary-decomposed byte contexts of all depths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import Rolling, U, byte_chunks, fold, lower_ascii, read, stage, tidy, unstage, word_spans

DEPTH = 5  # bytes of context
END = 255  # no byte of UTF-8; stands before and after every text
LOG10 = np.log(10)
WORD_BIT = U(1 << 63)
HOT_GRAMS, HOT_WORDS = 1 << 20, 1 << 19


# --- the symbols of a text ------------------------------------------------------------------------------------------


def grams(data: np.ndarray, ends: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of each row and one END after it, in its context: the nearest byte highest, the coded byte lowest. And
    the offsets of the rows. What a row has not is END."""
    per = np.diff(ends) + 1
    offsets = np.append(0, np.cumsum(per))
    text = np.full(offsets[-1], END, np.uint8)
    inside = np.ones(len(text), bool)
    inside[offsets[1:] - 1] = False
    text[inside] = data
    at = np.arange(len(text)) - np.repeat(offsets[:-1], per)
    out = text.astype(np.uint64)
    for k in range(1, depth + 1):
        before = np.full(len(text), END, np.uint64)
        before[k:] = text[: max(0, len(text) - k)]
        before[at < k] = END
        out |= before << U(8 * (depth + 1 - k))
    return out, offsets


def word_keys(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, with the top bit set, and how many words each row has."""
    starts, stops, per = word_spans(data, ends)
    return Rolling(data)(starts, stops) | WORD_BIT, per


def tally(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, training counts, counts) added up by key."""
    k, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    add = lambda i: np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(k)).astype(np.int64)
    return k, add(1), add(2)


def count_symbols(docs: DataFrame) -> DataFrame:
    """key, train_n, all_n of every word and every byte in its context, over all texts of docs (text, train)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            k, t, n = tally(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(t), pa.array(n)], names=["key", "train_n", "all_n"])

        for b in batches:
            train = np.asarray(b.column("train"))
            for lo, hi, data, ends in byte_chunks(b.column("text")):
                data = lower_ascii(data)
                g, offsets = grams(data, ends)
                w, per = word_keys(data, ends)
                for keys, count in ((g, np.diff(offsets)), (w, per)):
                    learn = np.repeat(train[lo:hi], count)
                    parts = [np.unique(keys[m], return_counts=True) for m in (learn, ~learn)]
                    held += [(k, c if i == 0 else np.zeros_like(c), c) for i, (k, c) in enumerate(parts)]
                if sum(len(p[0]) for p in held) > 3_000_000:
                    small = tally(held)
                    held[:] = [small]
                    if len(small[0]) > 1_500_000:
                        yield out()
        if held:
            yield out()

    return docs.select("text", "train").mapInArrow(tidy(made), "key long, train_n long, all_n long").groupBy("key").agg(F.sum("train_n").alias("train_n"), F.sum("all_n").alias("all_n"))


# --- the tree -------------------------------------------------------------------------------------------------------


def _half_gammas(n: np.ndarray) -> np.ndarray:
    """log(Gamma(n + 1/2) / Gamma(1/2)) of whole numbers."""
    return _lgamma(n + 0.5) - 0.5 * np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: Stirling's series from 8 upward, recurrence below."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _half_gammas(n0) + _half_gammas(n1) - _lgamma(n0 + n1 + 1)


class Level:
    """The nodes of one depth: (context, place in the byte's binary tree) with counts, and their weighted probability."""

    def __init__(self, nodes: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        """below: the sum of the children's log weighted probabilities; None at the deepest level."""
        self.nodes, self.n0, self.n1 = nodes, n0, n1
        own = kt_log(n0, n1)
        if below is None:
            self.log_weighted, self.own_share = own, np.ones(len(nodes))
        else:
            top = np.maximum(own, below)
            self.log_weighted = top + np.log(0.5 * np.exp(own - top) + 0.5 * np.exp(below - top))
            self.own_share = 0.5 * np.exp(own - self.log_weighted)

    def predict(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """The probability of the bit: this node's own estimate mixed with that of the deeper ones."""
        own = (np.where(bit, self.n1[at], self.n0[at]) + 0.5) / (self.n0[at] + self.n1[at] + 1)
        return own if deeper is None else self.own_share[at] * own + (1 - self.own_share[at]) * deeper


def local_levels(keys: np.ndarray, counts: np.ndarray, depth: int, down_to: int):
    """Levels depth, depth - 1, ... down_to over sorted grams, each with the node of (gram, bit); and what the last
    level hands up: the parent's node of each of its nodes."""
    sym = keys & U(255)
    bits = np.arange(8, dtype=np.uint64)
    place = (U(1) << bits)[None, :] | (sym[:, None] >> (U(8) - bits)[None, :])
    bit = ((sym[:, None] >> (U(7) - bits)[None, :]) & U(1)).astype(bool)
    levels, below, child_up = [], None, None
    for d in range(depth, down_to - 1, -1):
        context = keys >> U(8 * (depth + 1 - d))
        ids = ((context << U(8))[:, None] | place).reshape(-1)
        nodes, inverse = np.unique(ids, return_inverse=True)
        n = np.repeat(counts, 8).astype(float)
        n1 = np.bincount(inverse, n * bit.reshape(-1), len(nodes))
        n0 = np.bincount(inverse, n * ~bit.reshape(-1), len(nodes))
        if levels:
            up = np.searchsorted(nodes, child_up)
            below = np.bincount(up, levels[-1][0].log_weighted, len(nodes))
        level = Level(nodes, n0, n1, below)
        levels.append((level, inverse.reshape(-1, 8)))
        # the parent of (context, place) has the context without its farthest byte
        child_up = ((nodes >> U(16)) << U(8)) | (nodes & U(255))
    return levels, bit, child_up


def upper_levels(table: np.ndarray) -> tuple[Level, Level]:
    """Levels 1 and 0 from rows (node, n0, n1, below) of level 1, dense: 65,536 and 256 nodes at most."""
    n0, n1, below = np.zeros(65536), np.zeros(65536), np.zeros(65536)
    at = table[:, 0].astype(np.int64)
    n0[at], n1[at], below[at] = table[:, 1], table[:, 2], table[:, 3]
    one = Level(np.arange(65536), n0, n1, below)
    fold_ = lambda x: x.reshape(256, 256).sum(0)
    return one, Level(np.arange(256), fold_(n0), fold_(n1), fold_(one.log_weighted))


def gram_log10(keys: np.ndarray, counts: np.ndarray, one: Level, zero: Level, depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context; keys sorted, whole (c1, c2) groups."""
    levels, bit, _ = local_levels(keys, counts, depth, 2)
    p = None
    for level, at in levels:
        p = level.predict(at, bit, p)
    sym, c1 = keys & U(255), keys >> U(8 * depth)
    bits = np.arange(8, dtype=np.uint64)
    place = ((U(1) << bits)[None, :] | (sym[:, None] >> (U(8) - bits)[None, :])).astype(np.int64)
    p = one.predict((c1.astype(np.int64) << 8)[:, None] | place, bit, p)
    p = zero.predict(place, bit, p)
    return np.log(p).sum(1) / LOG10


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows of a partition in parts that end where the two nearest bytes change."""
    held: list[tuple] = []
    for b in batches:
        held.append(tuple(np.asarray(b.column(c)) for c in ("key", "train_n", "all_n")))
        if sum(len(h[0]) for h in held) < least:
            continue
        k, t, n = (np.concatenate(c) for c in zip(*held))
        edge = np.flatnonzero(np.diff(k >> (8 * (DEPTH - 1))))
        if len(edge):
            e = edge[-1] + 1
            yield k[:e].view(np.uint64), t[:e], n[:e]
            k, t, n = k[e:], t[e:], n[e:]
        held = [(k, t, n)]
    if held:
        k, t, n = (np.concatenate(c) for c in zip(*held))
        if len(k):
            yield k.view(np.uint64), t, n


def tree_values(counts: DataFrame) -> DataFrame:
    """key, value (log10 probability), all_n of every gram, from its training count, by the weighted context tree."""
    laid = counts.where("key >= 0").repartition(F.shiftright("key", 8 * (DEPTH - 1))).sortWithinPartitions("key")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t, _ in whole_groups(batches):
            levels, _, parent = local_levels(k, t, DEPTH, 2)
            level = levels[-1][0]
            nodes, inverse = np.unique(parent, return_inverse=True)
            add = lambda x: pa.array(np.bincount(inverse, x, len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), add(level.n0), add(level.n1), add(level.log_weighted)], names=["node", "n0", "n1", "below"])

    rows = laid.mapInArrow(tidy(up), "node long, n0 double, n1 double, below double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()
    top = counts.sparkSession.sparkContext.broadcast(upper_levels(np.column_stack([rows.column(c).to_numpy().astype(float) for c in ("node", "n0", "n1", "below")])))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t, n in whole_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(gram_log10(k, t, *top.value)), pa.array(n)], names=["key", "value", "all_n"])

    return laid.mapInArrow(tidy(down), "key long, value double, all_n long")


# --- scoring --------------------------------------------------------------------------------------------------------


class Hot:
    """Values of frequent keys in a table of fixed size: one slot a key, the more frequent key of a slot stays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, all_n: np.ndarray, size: int):
        self.shift = U(64 - (2 * size - 1).bit_length())
        slots = 1 << int(U(64) - self.shift)
        self.keys, self.values = np.full(slots, np.iinfo(np.uint64).max - U(1), np.uint64), np.zeros(slots)
        order = np.argsort(all_n, kind="stable")
        at = self.slot(keys[order])
        self.keys[at], self.values[at] = keys[order], values[order]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys aren't here (their value is 0)."""
        at = self.slot(keys)
        miss = self.keys[at] != keys
        v = self.values[at]
        v[miss] = 0
        return v, miss


def hot_table(values: DataFrame, most: int) -> Hot:
    """The keys with the highest counts, about `most` at the most: the bound of what is collected and broadcast. Counts are
    taken by eighths of their powers of two; of the first class that doesn't fit, a share of the keys by their hash."""
    size = F.floor(8 * F.log2(F.greatest("all_n", F.lit(1)))).cast("int")
    whole, share, left = 1 << 30, 0.0, most
    for r in values.groupBy(size.alias("size")).agg(F.count("key").alias("keys")).orderBy(F.desc("size")).collect():
        if r["keys"] > left:
            share = left / r["keys"]
            break
        whole, left = r["size"], left - r["keys"]
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cut = F.when(size >= whole, True).otherwise((size == r["size"]) & (part < share)) if left < most or share else F.lit(False)
    got = values.where(cut).select("key", "value", "all_n").toArrow()
    return Hot(got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy(), got.column("all_n").to_numpy(), most)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text, held_out).

    All texts are read whole, null as empty, with A-Z in lower case. score is the log10 probability of the text's bytes
    and of an end after them: each byte is eight binary decisions, each decision's probability mixes the
    Krichevsky-Trofimov estimates of contexts of 0 to DEPTH bytes by the weights of the context tree of all texts that
    aren't held out. base_score is that of its words and an end by smoothed word counts.

    Counts, tree and probabilities are tables. Only the most frequent words and grams, a fixed number, are broadcast;
    each text's other ones are joined to the tables. Without training texts all contexts predict evenly. Rows of equal
    doc_id and text score alike; a null doc_id is a held-out one; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "held_out", (~F.col("held_out")).alias("train"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("row"))
    counts = stage(count_symbols(docs), "ctw-counts")
    n, v = counts.where("key < 0 AND train_n > 0").agg(F.coalesce(F.sum("train_n"), F.lit(0)), F.count("key")).first()
    texts = docs.where("train").count()
    n, v = n + texts, v + (texts > 0)
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    grams_ = stage(tree_values(counts), "ctw-grams")
    words = counts.where("key < 0").select("key", F.col("train_n").cast("double").alias("value"), "all_n")
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast((hot_table(grams_, HOT_GRAMS), hot_table(words, HOT_WORDS)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each text with what its frequent symbols give (item: no key), and one of each of its other symbols."""
        hot_grams, hot_words = hot.value
        names = ["row", "item", "n", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
        for b in batches:
            for lo, hi, data, ends in byte_chunks(b.column("text"), 2 << 20):
                data = lower_ascii(data)
                rows = np.asarray(b.column("row"))[lo:hi]
                g, offsets = grams(data, ends)
                value, miss_g = hot_grams(g)
                score = np.add.reduceat(value, offsets[:-1])
                w, per = word_keys(data, ends)
                c, miss_w = hot_words(w)
                owner = np.repeat(np.arange(hi - lo), per)
                each = np.where(miss_w, 0, base(c))
                none = pa.nulls
                marks = (rows & ((1 << 62) - 1)) | (1 << 62)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(marks), pa.array(np.ones(hi - lo, np.int64)), b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), pa.array(per + 1),
                     pa.array(np.bincount(owner, ~miss_w & (c > 0), hi - lo).astype(np.int64) + (texts > 0)), pa.array(np.bincount(owner, each, hi - lo) + base(texts)), pa.array(score)],
                    names=names,
                )
                for keys, miss, own in ((g, miss_g, np.repeat(np.arange(hi - lo), np.diff(offsets))), (w, miss_w, owner)):
                    own, keys = own[miss], keys[miss]
                    o = np.lexsort((keys, own))
                    own, keys = own[o], keys[o]
                    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]))) if len(keys) else np.zeros(0, np.int64)
                    m = len(new)
                    number = np.diff(np.append(new, len(keys)))
                    kinds = [f.type for f in b.schema if f.name in ("doc_id", "held_out")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[own[new]]), pa.array(keys[new].view(np.int64)), pa.array(number), none(m, b.schema.field("doc_id").type), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64())],
                        names=names,
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "held_out", "row", "text").mapInArrow(tidy(scored), f"row long, item long, n long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    table = grams_.select("key", "value").union(words.select("key", "value"))
    # marks have no key; rare keys can't be skewed
    out = out.join(table, F.col("item") == F.col("key"), "left")
    is_word, is_gram, mark = F.col("item") < 0, (F.col("item") >= 0) & (F.col("item") < F.lit(1 << 62)), F.col("n_tokens").isNotNull()
    c = F.coalesce("value", F.lit(0.0))
    word_base = F.log10((c + 0.1) / F.lit(float(n + 0.1 * (v + 1))))
    out = out.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.count_if(mark).alias("times"),
        F.max("n_known").alias("k"), F.max("base").alias("b"), F.max("score").alias("s"),
        F.coalesce(F.sum(F.when(is_word & (c > 0), F.col("n"))), F.lit(0)).alias("k2"), F.coalesce(F.sum(F.when(is_word, F.col("n") * word_base)), F.lit(0.0)).alias("b2"), F.coalesce(F.sum(F.when(is_gram, F.col("n") * c)), F.lit(0.0)).alias("s2"),
    )
    times = F.col("times")
    out = out.select(
        "doc_id", "held_out", "n_tokens", (F.col("k") + F.floor(F.col("k2") / times)).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("b") + F.col("b2") / times).alias("base_score"), (F.col("s") + F.col("s2") / times).alias("score"), "times",
    )
    # rows of equal id and text were added up together
    return out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("i", "times")


def op6_context_tree(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold("doc_id", 10) == 0, F.lit(True)).alias("held_out"))
    return score_texts(docs)
