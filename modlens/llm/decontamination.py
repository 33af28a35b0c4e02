"""Benchmark passages in documents: the q-gram lemma over diagonal bands, and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from modlens.llm.common import SPACE, U, byte_chunks, read, stage, tidy

Q = 8  # bytes of a gram
SEGMENT = 100  # bytes of a window
SHORTEST = 24  # bytes; shorter items are no evidence of a leak
#: Bytes of benchmark text that one pass over the documents looks for: the bound of what is broadcast.
BLOCK = 4 << 20


def normal(column: pa.Array) -> pa.Array:
    """Lower case, and each run of white space as one space, none at the ends."""
    text = pc.utf8_lower(pc.fill_null(column, ""))
    return pc.utf8_trim(pc.replace_substring_regex(text, r"[\x20\x09-\x0D]+", " "), " ")


def squeeze(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same white space rule over joined bytes; a row keeps one space at an end."""
    space = SPACE[data]
    first = np.zeros(len(data), bool)
    first[ends[:-1][ends[:-1] < len(data)]] = True
    keep = ~(space & np.append(False, space[:-1]) & ~first)
    total = np.append(0, np.cumsum(keep))
    return np.where(space, np.uint8(32), data)[keep], total[ends]


def grams(data: np.ndarray) -> np.ndarray:
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.as_strided(data, (n, Q), (1, 1)).copy().view("<u8").reshape(-1)


class Items:
    """Benchmark items and an index of their grams; a window is any SEGMENT bytes of an item, or all of a shorter one."""

    def __init__(self, items: list[tuple[object, bytes]], share: float = 0.1):
        items = [(i, raw) for i, raw in items if len(raw) >= SHORTEST]
        self.item = [i for i, _ in items]
        self.text = np.frombuffer(b"".join(raw for _, raw in items), np.uint8)
        self.length = np.array([len(raw) for _, raw in items], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.size = np.minimum(self.length, SEGMENT)
        # With e edits a window of n bytes keeps n + 1 - Q - Q * e of its grams at least. The budget is a share of the
        # length, but no more than leaves 4 grams.
        self.edits = np.maximum(0, np.minimum((share * self.size).astype(np.int64), (self.size + 1 - Q - 4) // Q))
        self.least = self.size + 1 - Q - Q * self.edits
        #: Added to diagonals, so that none is negative and no band before the first is either.
        self.shift = int(self.length.max(initial=0)) + SEGMENT
        count = np.maximum(0, self.length + 1 - Q)
        owner = np.repeat(np.arange(len(items)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        keys = grams(self.text)[self.start[owner] + place]
        o = np.argsort(keys, kind="stable")
        self.owner, self.place = owner[o], place[o]
        self.keys, self.first = np.unique(keys[o], return_index=True)
        self.number = np.diff(np.append(self.first, len(keys)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.slot(self.keys)] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(44)).astype(np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, item and place in it of every gram that data shares with an item."""
        g = grams(data)
        at = np.flatnonzero(self.maybe[self.slot(g)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[k] == g[at]
        at, k = at[same], k[same]
        n = self.number[k]
        pos = np.repeat(at, n)
        post = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pos, self.owner[post], self.place[post]

    def windows(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, first diagonal, place in the item and fewest edits thinkable of every window of which a band holds
        as many grams as the edit budget leaves.

        A band starts at a multiple of e + 1 and is 2 * (e + 1) diagonals wide, so an alignment of e edits, which
        touches e + 1 neighbouring diagonals at the most, lies in one band as a whole.
        """
        pos, item, place = self.hits(data)
        row = np.searchsorted(ends, pos, "right") - 1
        inside = pos + Q <= ends[row + 1]
        pos, item, place, row = pos[inside], item[inside], place[inside], row[inside]
        band = (pos - place + self.shift) // (self.edits[item] + 1)
        key = item * np.int64(len(data) + 2 * self.shift) + band
        key, row, item = np.concatenate([key, key - 1]), np.concatenate([row, row]), np.concatenate([item, item])
        band, place = np.concatenate([band, band - 1]), np.concatenate([place, place])
        o = np.lexsort((place, row, key))
        key, row, item, band, place = key[o], row[o], item[o], band[o], place[o]
        new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))[: len(key)]
        once = new | np.append(True, place[1:] != place[:-1])[: len(key)]
        new, row, item, band, place = new[once], row[once], item[once], band[once], place[once]
        group = np.cumsum(new) - 1
        # The least grams from the i-th on lie in the windows from lo to hi; neither falls within a group, so what the
        # gram before has given is left out.
        i = np.arange(len(place))
        j = i + self.least[item] - 1
        full = j < len(place)
        i, j = i[full], j[full]
        i, j = i[group[i] == group[j]], j[group[i] == group[j]]
        span = self.size[item[i]] - Q
        lo = np.maximum(place[j] - span, 0)
        hi = np.minimum(place[i], (self.length - self.size)[item[i]])
        same = np.append(False, group[i][1:] == group[i][:-1])[: len(i)]
        lo[1:] = np.where(same[1:], np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
        n = np.maximum(0, hi - lo + 1)
        at = np.repeat(i, n)
        where = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.int64(self.shift + 1)
        seen, of = group * wide + place, group[at] * wide + where
        grams_of = self.size[item[at]] + 1 - Q
        found = np.searchsorted(seen, of + grams_of - 1, "right") - np.searchsorted(seen, of)
        return row[at], item[at], band[at] * (self.edits[item[at]] + 1) - self.shift, where, -((found - grams_of) // Q)

    def align(self, data: np.ndarray, ends: np.ndarray, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The least edits that turn each window into a substring of its row, with all steps within the band."""
        out = np.full(len(row), SEGMENT, np.int64)
        for n, e in sorted(set(zip(self.size[item].tolist(), self.edits[item].tolist()))):
            at = np.flatnonzero((self.size[item] == n) & (self.edits[item] == e))
            for part in np.array_split(at, len(at) // 4096 + 1):
                if not len(part):
                    continue
                wide = 2 * (e + 1)
                words = self.text[(self.start[item[part]] + place[part])[:, None] + np.arange(n)[None, :]].astype(np.int16)
                p = (diagonal[part] + place[part])[:, None] + np.arange(n + wide - 1)[None, :]
                real = (p >= ends[row[part]][:, None]) & (p < ends[row[part] + 1][:, None])
                text = np.where(real, data[np.clip(p, 0, len(data) - 1)].astype(np.int16), np.int16(-1))
                slope = np.arange(wide, dtype=np.int16)
                cost = np.zeros((len(part), wide), np.int16)
                for i in range(n):
                    t = cost + (text[:, i : i + wide] != words[:, i][:, None])
                    t[:, :-1] = np.minimum(t[:, :-1], cost[:, 1:] + np.int16(1))
                    cost = np.minimum.accumulate(t - slope, axis=1) + slope
                out[part] = cost.min(1)
        return out

    def found(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and fewest edits of every item of which a row holds a window within its budget.

        Of each row and item the most promising window is aligned first, then those that could still be better.
        """
        row, item, diagonal, place, bound = self.windows(data, ends)
        pair = row * np.int64(len(self.item) + 1) + item
        o = np.lexsort((bound, pair))
        row, item, diagonal, place, bound, pair = row[o], item[o], diagonal[o], place[o], bound[o], pair[o]
        new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        best = self.align(data, ends, row[first], item[first], diagonal[first], place[first])
        more = np.flatnonzero(~new & (bound < best[of]))
        np.minimum.at(best, of[more], self.align(data, ends, row[more], item[more], diagonal[more], place[more]))
        ok = best <= self.edits[item[first]]
        return row[first][ok], item[first][ok], best[ok]


def find_passages(docs: DataFrame, benchmark: DataFrame, share: float = 0.1) -> DataFrame:
    """doc_id, row, item_id, edits: the pairs of a document and a benchmark item of which it holds a passage.

    A passage is a stretch of SEGMENT bytes from anywhere in the item, or all of a shorter one, that the document holds
    with at most `share` of its length in edits, in lower case and with white space squeezed; edits is the fewest. Items
    of less than SHORTEST bytes and null texts aren't looked for. row is a hash of doc_id and text, as ids may be null
    or repeat; each repeated row is reported. No rows if either table is empty.

    The benchmark is cut by a hash of its items into parts of about BLOCK bytes, and each part is looked for in all
    documents, so what is broadcast is bounded whatever the benchmark's size.
    """
    spark = docs.sparkSession
    item = benchmark.select("item_id", F.col("text").alias("t")).where("t IS NOT NULL")
    held = item.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = int(held // BLOCK) + 1
    kind, id_kind = benchmark.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    b_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    mine = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    out = None
    for part in range(parts):
        rows = sorted(item.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part).collect(), key=lambda r: (str(r["item_id"]), r["t"]))
        texts = normal(pa.array([r["t"] for r in rows], pa.string())).to_pylist()
        index = spark.sparkContext.broadcast(Items([(r["item_id"], t.encode()) for r, t in zip(rows, texts)], share))

        def found(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            s = index.value
            for b in batches:
                for lo, hi, data, ends in byte_chunks(pc.utf8_lower(b.column("text")), 2 << 20):
                    data, ends = squeeze(data, ends)
                    row, item, edits = s.found(data, ends)
                    best: dict[tuple[int, object], int] = {}
                    for r, g, e in zip(row.tolist(), item.tolist(), edits.tolist()):
                        k = (r, s.item[g])
                        best[k] = min(e, best.get(k, e))
                    at = pa.array([lo + r for r, _ in best], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(at), b.column("row").take(at), pa.array([i for _, i in best], b_kind), pa.array(list(best.values()), pa.int64())], names=["doc_id", "row", "item_id", "edits"]
                    )

        one = mine.mapInArrow(tidy(found), f"doc_id {id_kind}, row long, item_id {kind}, edits long")
        out = one if out is None else out.union(one)
    return out


def op9_benchmark_passages(spark, sf_dir):
    """doc_id, item_id, edits of every pair of find_passages."""
    return find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "edits")


def without_passages(docs: DataFrame, benchmark: DataFrame, share: float = 0.1) -> DataFrame:
    """docs without those that hold a benchmark passage; columns as before."""
    found = stage(find_passages(docs, benchmark, share).select(F.col("row").alias("leaked")).distinct(), "leaks")
    row = F.xxhash64("doc_id", "text")
    return docs.join(found, row == F.col("leaked"), "left_anti")
