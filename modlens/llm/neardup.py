"""MinHash near-duplicates: fast similarity sketching, banding, and verification on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import Rolling, U, byte_chunks, filter_slot, free_name, in_filter, key_filter, lower_ascii, mix, read, stage, tidy, unstage, word_spans
from modlens.llm.graph import components

COORDS = 512  # of a sketch; a power of two
ROWS = 4  # coordinates of a band
M = (1 << 64) - 1
_K = mix(np.arange(11, 11 + 64, dtype=np.uint64))


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, joined, and how many each row has."""
    data = lower_ascii(data)
    starts, stops, words = word_spans(data, ends)
    w = Rolling(data)(starts, stops) if len(starts) else np.zeros(0, np.uint64)
    first = np.cumsum(words) - words
    number = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), number)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    long = np.minimum(words[row], width)
    h = long.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    for k in range(width):
        on = long > k
        h[on] += w[at[on] + k] * _K[k]
    h = mix(h)
    cut = np.append(0, np.cumsum(number))
    sets = [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return (np.concatenate(sets) if sets else h), np.array([len(s) for s in sets], np.int64)


def sketches(shingles: np.ndarray, sizes: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Fast similarity sketches. In round i each shingle goes to one hashed coordinate with a value in [i, i + 1); a
    coordinate keeps the smallest. A row is done when all its coordinates are filled; from round `coords` on each round
    puts every shingle into one given coordinate, so that 2 * coords rounds fill any row that has a shingle."""
    empty = np.iinfo(np.uint64).max
    out = np.full((len(sizes), coords), empty, np.uint64)
    flat = out.reshape(-1)
    row, h = np.repeat(np.arange(len(sizes)), sizes), shingles
    left = np.flatnonzero(sizes)
    for i in range(2 * coords):
        if not len(h):
            break
        v = mix(h + U((i + 1) * 0x9E3779B97F4A7C15 & M))
        bin_ = (v & U(coords - 1)).astype(np.int64) if i < coords else np.full(len(h), i - coords)
        np.minimum.at(flat, row * coords + bin_, (U(i) << U(48)) | (v >> U(16)))
        if i % 4 == 3:  # values only grow by rounds, so a row that stays longer keeps its sketch
            open_ = np.zeros(len(sizes), bool)
            open_[left] = (out[left] == empty).any(1)
            left = np.flatnonzero(open_)
            stay = open_[row]
            row, h = row[stay], h[stay]
    return out


def bands_for(share: float, miss: float = 1e-6) -> int:
    """Bands of ROWS coordinates with which a pair of similarity `share` is missed with a probability of at most `miss`."""
    return min(COORDS // ROWS, math.ceil(math.log(miss) / math.log(1 - share**ROWS)))


def most_different(share: float, sigmas: float = 5.0) -> int:
    """Of COORDS two-bit coordinates, how many may differ in a pair of similarity `share` or more, `sigmas` deviations out."""
    e = share + (1 - share) / 4
    return math.ceil(COORDS * (1 - e) + sigmas * math.sqrt(COORDS * e * (1 - e)))


def two_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a long."""
    two = (mix(sketch) & U(3)).reshape(len(sketch), COORDS // 32, 32) << (U(2) * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(two, axis=2)


def node_hashes(shingles: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """16 bytes for each row's sorted shingles: at 10**10 different sets two are still unlikely to meet."""
    raw = shingles.astype("<u8").tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:])]


def signatures(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, key, node, n, sketch, bands of each row of docs (doc_id, key, text). node is 16 bytes of a hash of the
    shingle set, so rows of equal sets share it; without words it is a hash of doc_id and text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, ends in byte_chunks(b.column("text")):
                sh, n = shingle_sets(data, ends, width)
                cut = np.append(0, np.cumsum(n))
                key = np.asarray(b.column("key"))[lo:hi]
                node = node_hashes(sh, cut)
                for i in np.flatnonzero(n == 0):
                    row = f"{b.column('doc_id')[lo + i].as_py()!r} {b.column('text')[lo + i].as_py()!r}"
                    node[i] = hashlib.blake2b(row.encode("utf-8", "replace"), digest_size=16, person=b"no words").digest()
                sk = sketches(sh, n)
                band = np.zeros((hi - lo, bands), np.uint64)
                for j in range(bands):
                    band[:, j] = mix((sk[:, ROWS * j : ROWS * (j + 1)] * _K[:ROWS]).sum(1, dtype=np.uint64) + _K[32 + j % 32] + U(j))
                full = n > 0
                per = COORDS // 32
                longs = lambda x, k: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full * k)), pa.int32()), pa.array(x[full].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(key), pa.array(node, pa.binary()), pa.array(n), longs(two_bits(sk), per), longs(band, bands)],
                    names=["doc_id", "key", "node", "n", "sketch", "bands"],
                )

    return docs.select("doc_id", "key", "text").mapInArrow(tidy(made), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, node binary, n long, sketch array<long>, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, shingles of the wanted nodes (node, key). A fixed-size filter on the key of one of a node's rows spares other texts the work."""
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "key"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_filter(bits.value, np.asarray(b.column("slot")))))
            for _, _, data, ends in byte_chunks(b.column("text")):
                sh, n = shingle_sets(data, ends, width)
                cut = np.append(0, np.cumsum(n))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(sh.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node_hashes(sh, cut), pa.binary()), lists], names=["of_node", "shingles"])

    sets = docs.select(filter_slot("key").alias("slot"), "text").mapInArrow(tidy(made), "of_node binary, shingles array<long>")
    # rows that pass the filter by chance may be of a wanted node too
    return sets.join(wanted.select("node"), F.col("of_node") == F.col("node")).groupBy("node").agg(F.first("shingles").alias("shingles"))


LONGS = COORDS // 32
#: What a candidate's row carries: sketch words and sizes, as columns of their own.
FACTS = [f"s{i}" for i in range(LONGS)] + ["size", "common"]


def _different(a: str, b: str) -> Column:
    """Coordinates whose two bits differ; a and b are prefixes of column names."""
    total = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two rows can be linked: by the shingles that other sets have too, and by their sketches."""
    m = F.least(F.col(f"{a}common"), F.col(f"{b}common"))
    return (100 * m >= percent * (F.col(f"{a}size") + F.col(f"{b}size") - m)) & (_different(a, b) <= most_different(percent / 100))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| of their full sets."""
    sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(sb, "b").join(sa, "a")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    both = both.where(100 * small >= percent * large).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def able_to_link(sets: DataFrame, percent: int) -> DataFrame:
    """node, size, common of the sets that can be linked at all. common: how many of its shingles another set here has
    too, which no intersection exceeds. Sets of equal shingles are one node, so a shingle counts once a set."""
    own = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("node").alias("n"), F.min("node").alias("of"))
    alone = own.where("n = 1").groupBy("of").agg(F.count("s").alias("alone"))
    out = sets.select("node", F.size("shingles").cast("long").alias("size")).join(alone, F.col("node") == F.col("of"), "left")
    out = out.select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))
    return out.where(100 * F.col("common") >= percent * F.col("size"))


def rooted(df: DataFrame, node: str, name: str, roots: DataFrame | None) -> DataFrame:
    """df with the component of its node column; a node without links is its own."""
    if roots is None:
        return df.withColumn(name, F.col(node))
    r = roots.select(F.col("node").alias("at_"), F.col("root").alias("root_"))
    return df.join(r, F.col(node) == F.col("at_"), "left").withColumn(name, F.coalesce("root_", node)).drop("at_", "root_")


def best_heads(nodes: DataFrame, key: str, roots: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b): each node with the nearest head of its buckets that is of another component.

    key: an array column with the node's buckets. A bucket's head is its most central set: that with the largest share
    of shingles that others have too. Buckets are summed up before the join, so a hot one sends one head.
    """
    rows = rooted(nodes, "node", "mine", roots).withColumn("bucket", F.explode(key)).drop("bands", "pairs", "fours")
    central = F.struct((-F.col("common") / F.col("size")).alias("c"), *["node", "mine", *FACTS])
    heads = rows.groupBy("bucket").agg(F.min(central).alias("h"), F.count("node").alias("n")).where("n > 1").select(F.col("bucket").alias("of"), *[F.col(f"h.{c}").alias(f"h_{c}") for c in ["node", "mine", *FACTS]])
    met = rows.join(heads, F.col("bucket") == F.col("of")).where((F.col("mine") != F.col("h_mine")) & _near("", "h_", percent))
    return met.groupBy(F.col("node").alias("a")).agg(F.min(F.struct(_different("", "h_").alias("d"), F.col("h_node").alias("b"))).alias("x")).select("a", "x.b")


def linked_nodes(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """node, root of the nodes that are linked with another.

    Candidates share a band, agree in enough two-bit coordinates, and have enough shingles that other sets have too: of
    a set with more than its share of shingles of its own, no link is possible. Not all pairs of a bucket are verified,
    but every pair of one is decided: what is in one component already needs no further link. So nodes are first
    verified against the heads of buckets of one, two and four bands, and components are formed after each; of the
    buckets that then still hold several, each node outside its bucket's largest component is verified against every
    partner of another component that it hasn't met yet.
    """
    reps = stage(signed.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "near-reps")
    rows = reps.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("node").alias("members")).where("members > 1").select(F.col("band").alias("of"))
    wanted = rows.join(shared, F.col("band") == F.col("of")).select(F.col("node").alias("at")).distinct()
    wanted = stage(reps.join(wanted, F.col("node") == F.col("at")).select(*reps.columns), "near-wanted")
    sets = stage(full_sets(docs, wanted.select("node", "key"), width), "near-sets")
    able = able_to_link(sets, percent).withColumnRenamed("node", "at")
    bands = bands_for(percent / 100)
    more = [F.array(*[F.xxhash64(*[F.get("bands", F.lit(i + j)) for j in range(k)]) for i in range(bands - k + 1)]).alias(name) for k, name in ((2, "pairs"), (4, "fours"))]
    nodes = stage(wanted.join(able, F.col("node") == F.col("at")).select("node", "bands", *more, *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(LONGS)], "size", "common"), "near-nodes")
    unstage(reps, wanted)

    links, tried, roots = [], [], None
    for key in ("bands", "pairs", "fours"):
        tried.append(stage(best_heads(nodes, key, roots, percent), "near-pairs"))
        links.append(stage(confirmed(tried[-1], sets, percent), "near-links"))
        if roots is not None:
            unstage(roots)
        roots = components(reduce(DataFrame.union, links))

    here = stage(rooted(nodes, "node", "mine", roots).select("*", F.posexplode("bands").alias("place", "band")).drop("pairs", "fours"), "near-rooted")
    parts = here.groupBy("band", "mine").agg(F.count("node").alias("k")).groupBy("band").agg(F.max(F.struct("k", "mine")).alias("top"), F.count("mine").alias("roots"))
    mixed = parts.where("roots > 1").select(F.col("band").alias("of"), F.col("top.mine").alias("largest"))
    members = stage(here.join(mixed, F.col("band") == F.col("of")).drop("of"), "near-mixed")
    outside = prefixed(members.where("mine <> largest").drop("largest"), "o_")
    # a pair of two outside nodes meets once, in the order of ids, and any pair in the first band of both only
    once = (F.col("mine") == F.col("largest")) | (F.col("o_node") < F.col("node"))
    for j in range(bands):
        once = once & ((F.col("place") <= j) | (F.get("o_bands", F.lit(j)) != F.get("bands", F.lit(j))))
    meet = (F.col("o_band") == F.col("band")) & (F.col("o_mine") != F.col("mine")) & _near("o_", "", percent) & once
    cross = outside.join(members, meet).select(F.least("o_node", "node").alias("a"), F.greatest("o_node", "node").alias("b"))
    done = reduce(DataFrame.union, tried).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    open_ = stage(cross.join(done, ["a", "b"], "left_anti"), "near-open")
    unstage(here, members, *tried, nodes)
    if not open_.isEmpty():
        links.append(stage(confirmed(open_, sets, percent), "near-links"))
        unstage(roots)
        roots = components(reduce(DataFrame.union, links))
    unstage(sets, *links, open_)
    return roots


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key, n, root of each row of docs (doc_id, text): rows of one root are linked, directly or through others."""
    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    signed = stage(signatures(docs, width, bands_for(percent / 100)), "near-signed")
    roots = linked_nodes(docs, signed, width, percent).select(F.col("node").alias("at"), "root")
    out = stage(signed.join(roots, F.col("node") == F.col("at"), "left").select("doc_id", "key", "n", F.coalesce("root", "node").alias("root")), "near-grouped")
    unstage(signed)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Rows are linked if their sets of `width`-word shingles, of the ASCII-lower-cased whole text, have a Jaccard
    similarity of percent / 100 or more; component_id is the smallest doc_id that links reach. A text with fewer words
    is one shingle; one without words, or null, is linked with nothing; a very long one has a large set, read whole.
    Rows of equal sets form one class, so copies aren't compared with one another. Null ids don't become a component_id
    unless all ids of a component are null; repeated rows are in one component, and all rows of its smallest id are
    kept. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    of = grouped(docs, width, percent)
    ids = of.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "r")
    return of.join(ids, F.col("root") == F.col("r")).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates; columns as before.

    It is a row of the smallest doc_id, a null one only if all are null; of rows of that id with different texts the one
    of least hash stays. Rows of one id that aren't linked are rows of different groups, and each may stay. Repeated rows
    are one group, those without words too. An empty table gives no rows; other columns go along, whatever their names.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")
    of = grouped(docs, width, percent)
    kept = of.groupBy("root").agg(first).select(F.col("f.doc_id").alias("kept_id"), F.col("f.key").alias("kept_key"))
    rows = of.select("doc_id", "key").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    kept = stage(kept.join(rows, (F.col("kept_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("kept_id", "kept_key", "copies"), "near-kept")
    mine = free_name(docs, "row_key")
    keyed = docs.withColumn(mine, F.xxhash64("doc_id", "text"))
    on = (F.col(mine) == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    again = kept.where("copies > 1")
    out = keyed.join(kept.where("copies = 1"), on, "left_semi")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.drop(mine)
