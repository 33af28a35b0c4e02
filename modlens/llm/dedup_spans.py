"""Removal of long byte strings that occur more than once, by suffix arrays over buckets of equal windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import Rolling, U, byte_chunks, filter_slot, in_filter, key_filter, read, stage, tidy, unstage
from modlens.llm.suffixes import share_start, suffix_array

#: Bytes of the gram whose smallest hash names a window's bucket; and, of the pieces of buckets that hold too many kinds, the
#: gram's share of the window. A long gram parts windows that share a passage by what stands beside it.
GRAM, LONG_GRAM = 64, 0.8
PIECES = 384  # of one suffix array, so that its text stays small
TEXT = 256 << 10
CHUNK = 128 << 10  # bytes of short texts that are cut at once, so that their hashes stay in the processor's cache
SHAPE = 15  # bits of each number of a piece's shape; windows are below 32,768 bytes


def window_minima(h: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each window of `width` bytes the position of its leftmost gram of least hash; h holds the grams' hashes."""
    w = width - gram + 1
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = U(max(20, int(len(h)).bit_length()))
    low = (U(1) << bits) - U(1)
    # grams compare by the hash's upper bits, then by position
    x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    pad = -len(x) % w
    blocks = np.append(x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    from_left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    best = np.minimum(from_right[:n], from_left[w - 1 : w - 1 + n])
    return (best & low).astype(np.int64)


def window_runs(h: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram, first window and number of windows of every run of windows, inside one row, with the same least gram."""
    at = window_minima(h, width, gram)
    sizes = np.diff(ends)
    edge = np.zeros(len(at) + 1, np.int64)
    some = sizes >= width
    np.add.at(edge, ends[:-1][some], 1)
    np.add.at(edge, ends[1:][some] - width + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:-1]))
    least = at[window]
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1])[: len(least)])
    return least[first], window[first], np.diff(np.append(first, len(least)))


def cut_pieces(data: np.ndarray, ends: np.ndarray, width: int, passage: int | None = None, gram: int = GRAM):
    """Row, start in the row, shape, bucket and content hash of every piece: all windows of one row with the same least gram.

    Windows of equal bytes have the same least gram and so the same bucket; each window is in one piece, and a piece
    reaches from its first window's first byte to its last window's last one. Nothing crosses the border of a row. With
    a passage, the windows of `passage` bytes with that least gram are in the same piece: the least gram of a window is
    that of a smaller window inside it too, so the smaller windows have all the grams. The shape is where the windows
    begin in the piece and how many they are, in four numbers of SHAPE bits: those of `width` bytes, then of `passage`.
    """
    rolling = Rolling(data)
    h = rolling.every(gram)
    widths = [width] if passage is None else sorted({width, passage})
    found = {w: window_runs(h, ends, w, gram) for w in widths}
    least, start, k = found[widths[0]]
    end = start + k + widths[0] - 1
    start = start.copy()
    for w in widths[1:]:
        g, s, n = found[w]
        j = np.searchsorted(least, g)
        start[j], end[j] = np.minimum(start[j], s), np.maximum(end[j], s + n + w - 1)
    shape = np.zeros(len(least), np.int64)
    for i, w in enumerate([width] if passage is None else [width, passage]):
        g, s, n = found[w]
        j = np.searchsorted(least, g)
        shape[j] |= (s - start[j] | n << SHAPE) << 2 * SHAPE * i
    row = np.searchsorted(ends, start, "right") - 1
    return row, start - ends[row], shape, h[least], rolling(start, end)


def shape_of(shape: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four numbers of each shape."""
    return tuple(shape >> SHAPE * i & (1 << SHAPE) - 1 for i in range(4))


def windows_in(i: int) -> Column:
    """How many windows of `width` (0) or `passage` (1) bytes a piece has."""
    return F.shiftright("shape", 2 * SHAPE * i + SHAPE).bitwiseAND(F.lit((1 << SHAPE) - 1)).cast("int")


def windows_from(i: int) -> Column:
    """Where in the piece they begin."""
    return F.shiftright("shape", 2 * SHAPE * i).bitwiseAND(F.lit((1 << SHAPE) - 1)).cast("int")


def piece_bytes(width: int, passage: int | None) -> Column:
    sizes = [F.when(windows_in(i) > 0, windows_from(i) + windows_in(i) + (w - 1)) for i, w in enumerate((width, passage or width))]
    return F.greatest(*sizes)


def repeated_windows(pieces: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each piece, which of its windows equal another window of these pieces; and, of each distinct window, the
    piece and the start of one occurrence."""
    text = np.frombuffer(b"\xff".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes + 1) - sizes - 1
    starts = np.zeros(len(text) + 1, np.int64)
    starts[begin] += 1
    starts[begin + sizes - width + 1] -= 1
    order = suffix_array(text, width, np.cumsum(starts[:-1]) > 0)
    piece = np.searchsorted(begin, order, "right") - 1
    at = order - begin[piece]
    same = share_start(text, order, width)
    hit = np.zeros(len(order), bool)
    hit[:-1] |= same
    hit[1:] |= same
    marks = [np.zeros(n - width + 1, bool) for n in sizes]
    flat = np.concatenate(marks)
    base = np.cumsum([len(m) for m in marks]) - [len(m) for m in marks]
    flat[base[piece[hit]] + at[hit]] = True
    fresh = np.append(True, ~same)[: len(order)]
    return np.split(flat, base[1:]), piece[fresh], at[fresh]


def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]])))
    return edge[::2], edge[1::2]


def find_pieces(docs: DataFrame, width: int, passage: int | None, gram: int) -> DataFrame:
    """key, start, shape, bucket, content of every piece of docs (key, raw)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, ends in byte_chunks(b.column("raw"), CHUNK):
                row, start, shape, bucket, content = cut_pieces(data, ends, width, passage, gram)
                key = np.asarray(b.column("key"))[lo:hi][row]
                columns = (key, start.astype(np.int32), shape, bucket.view(np.int64), content.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "start", "shape", "bucket", "content"])

    return docs.select("key", "raw").mapInArrow(tidy(made), "key long, start int, shape long, bucket long, content long")


def known_kinds(pieces: DataFrame) -> DataFrame:
    """The kinds (bucket, content) of buckets that hold two pieces or more: shape, copies, smallest and largest key, one
    place (key, start); of the bucket: kinds, those with windows of `width` bytes (long_kinds), whether it has several
    documents, one of them alone in a kind (open)."""
    kinds = stage(pieces.groupBy("bucket", "content", "shape").agg(F.count("key").alias("copies"), F.min("key").alias("key"), F.max("key").alias("hi"), F.min_by("start", "key").alias("start")), "span-kinds")
    alone = F.max(F.when(F.col("key") == F.col("hi"), 1).otherwise(0)) == 1
    sizes = kinds.groupBy("bucket").agg(F.sum("copies").alias("all"), F.count("content").alias("kinds"), F.count(F.when(windows_in(0) > 0, 1)).alias("long_kinds"), ((F.min("key") < F.max("hi")) & alone).alias("open"))
    sizes = sizes.where(F.col("all") > 1).select(F.col("bucket").alias("b"), "kinds", "long_kinds", "open")
    known = stage(kinds.join(sizes, F.col("bucket") == F.col("b")).select("bucket", "content", "shape", "copies", "kinds", "long_kinds", "open", "key", "hi", "start"), "span-known")
    unstage(kinds)
    return known


_CUTS = "bucket long, content long, block int, many boolean, shape long, lo long, hi long"


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """bucket, content, block, many, shape, lo, hi and the bytes (piece) of the wanted pieces of docs (key, raw). A fixed-size filter keeps other documents out of the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "key"))
    names = [c.split()[0] for c in _CUTS.split(", ")]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(bits.value, np.asarray(b.column("slot"))))).drop_columns(["slot"])

    texts = docs.select("key", filter_slot("key").alias("slot"), "raw").mapInArrow(tidy(passed), "key long, raw binary")
    each = wanted.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("start", "size", *names)).alias("cuts"))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = b.column("cuts")
            flat = cuts.flatten()
            start = flat.field("start").to_numpy()
            until = (start + flat.field("size").to_numpy()).tolist()
            start, ends = start.tolist(), (np.asarray(cuts.offsets) - cuts.offsets[0].as_py()).tolist()
            found = []
            for raw, x, y in zip(b.column("raw"), ends, ends[1:]):
                text = raw.as_py()
                found += [text[i:j] for i, j in zip(start[x:y], until[x:y])]
            yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in names], pa.array(found, pa.binary())], names=[*names, "piece"])

    return texts.join(each, F.col("key") == F.col("of")).select("raw", "cuts").mapInArrow(tidy(sliced), f"{_CUTS}, piece binary")


def sharing_pieces(pieces: list[bytes], shape: np.ndarray, lo: np.ndarray, hi: np.ndarray, passage: int) -> np.ndarray:
    """Those of the pieces with a window of `passage` bytes, told by its hash, of two documents; lo and hi are a piece's
    smallest and largest one."""
    _, _, first, many = shape_of(shape)
    sizes = np.array([len(p) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), many)
    start = (np.cumsum(sizes) - sizes + first)[piece] + np.arange(len(piece)) - (np.cumsum(many) - many)[piece]
    h = Rolling(np.frombuffer(b"".join(pieces), np.uint8))(start, start + passage)
    order = np.argsort(h, kind="stable")
    if not len(order):
        return order
    h, piece = h[order], piece[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    shared = np.minimum.reduceat(lo[piece], new) < np.maximum.reduceat(hi[piece], new)
    return np.unique(piece[np.repeat(shared, np.diff(np.append(new, len(h))))])


_FOUND = "bucket long, content long, begin int, until int, window long"


def sort_buckets(pieces: DataFrame, width: int, parts: int, passage: int | None = None) -> DataFrame:
    """Suffix arrays over whole blocks of buckets, several to an array.

    Rows with begin < until are runs of windows of a piece that occur twice in its block. Of buckets of several blocks
    (many = true), a row of each distinct window follows, with its hash: until = begin + 1 if it occurs once in the
    block, until = begin if not. With a passage, a piece that shares one with another document of its block has a row
    without begin.
    """
    laid = pieces.repartition(parts, "bucket", "block").sortWithinPartitions("bucket", "block", "content")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        bucket, content, _, many, shape, lo, hi, text = zip(*rows)
        shape = np.array(shape)
        first, k = shape_of(shape)[:2]
        long = np.flatnonzero(k)
        out: list[list[np.ndarray]] = [[], [], [], []]

        def add(row, begin, until, window):
            for o, v in zip(out, (row, begin, until, window)):
                o.append(np.asarray(v, np.int64))

        if len(long):
            marks, piece, at = repeated_windows([text[i][first[i] : first[i] + k[i] + width - 1] for i in long.tolist()], width)
            # a False between the pieces, so that no run crosses their borders
            begins = np.cumsum(k[long] + 1) - k[long] - 1
            flat = np.zeros(int((k[long] + 1).sum()), bool)
            flat[np.concatenate([np.arange(b, b + len(m)) for b, m in zip(begins, marks)])] = np.concatenate(marks)
            x, y = runs(flat)
            p = np.searchsorted(begins, x, "right") - 1
            shift = first[long[p]] - begins[p]
            add(long[p], x + shift, y + shift, np.zeros(len(p)))
            open_ = [(int(long[p]), int(first[long[p]]) + a, bool(marks[p][a])) for p, a in zip(piece.tolist(), at.tolist()) if many[long[p]]] if any(many) else []
            h = [int.from_bytes(hashlib.blake2b(text[r][a : a + width], digest_size=8).digest(), "little", signed=True) for r, a, _ in open_]
            add([r for r, _, _ in open_], [a for _, a, _ in open_], [a if twice else a + 1 for _, a, twice in open_], h)
        hashed = sum(len(o) for o in out[3][1:])
        if passage:
            met = sharing_pieces(text, shape, np.array(lo), np.array(hi), passage)
            add(met, np.full(len(met), -1), np.zeros(len(met)), np.zeros(len(met)))
        row, begin, until, window = (np.concatenate([*o, np.zeros(0, np.int64)]) for o in out)
        n = len(out[3][0]) if len(long) else 0
        plain = np.ones(len(row), bool)
        plain[n : n + hashed] = False
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(bucket)[row]), pa.array(np.array(content)[row]), pa.array(begin.astype(np.int32), mask=begin < 0), pa.array(until.astype(np.int32), mask=begin < 0), pa.array(window, mask=plain)],
            names=["bucket", "content", "begin", "until", "window"],
        )

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "content", "block", "many", "shape", "lo", "hi", "piece"))):
                if size >= TEXT and r[:1] + r[2:3] != last:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[-1])
                last = r[:1] + r[2:3]
        if rows:
            yield flush(rows)

    return laid.mapInArrow(tidy(sorted_), _FOUND)


def placed(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    """key, s: the marked runs of windows (bucket, content, begin, until) at all places of their pieces, as structs of a and
    b; s is null for a mark without begin. The marks are a table of one row a content, so that Spark can split a content
    with very many places."""
    run = F.when(F.col("begin").isNotNull(), F.struct("begin", "until"))
    m = stage(marks.groupBy(F.col("bucket").alias("mb"), F.col("content").alias("mc")).agg(F.collect_set(run).alias("marks"), F.max(F.col("begin").isNull()).alias("shared")), "span-marks")
    at = pieces.join(m, (F.col("bucket") == F.col("mb")) & (F.col("content") == F.col("mc")))
    shifted = F.transform("marks", lambda x: F.struct((F.col("start") + x["begin"]).alias("a"), (F.col("start") + x["until"]).alias("b")))
    return at.select("key", "shared", F.explode_outer(shifted).alias("s"))


def whole(known: DataFrame) -> DataFrame:
    """All windows of a piece with copies repeat."""
    return known.where((F.col("copies") > 1) & (windows_in(0) > 0)).select("bucket", "content", windows_from(0).alias("begin"), (windows_from(0) + windows_in(0)).alias("until"))


def inside_pieces(texts: DataFrame, width: int) -> DataFrame:
    """key, a, b: the runs of windows that two of these texts (key, raw) share, by suffix arrays over buckets of long grams."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = stage(find_pieces(texts, width, None, int(LONG_GRAM * width)), "span-inner")
    known = known_kinds(pieces)
    blocks = F.ceil(F.col("kinds") / F.lit(float(PIECES)))
    wanted = known.where("kinds > 1").select("bucket", "content", "shape", "key", F.col("key").alias("lo"), "hi", "start", piece_bytes(width, None).alias("size"), (F.col("kinds") > PIECES).alias("many"), F.pmod(F.xxhash64("content"), blocks).cast("int").alias("block"))
    wanted = stage(wanted, "span-wanted")
    held = stage(texts_of(texts, wanted), "span-texts")
    found = stage(sort_buckets(held, width, parts), "span-found")
    unstage(held, wanted)
    here = found.where("window IS NULL").select("bucket", "content", "begin", "until")
    # of hot buckets: windows that several blocks have
    single = found.where("window IS NOT NULL")
    across = single.groupBy("bucket", "window").agg(F.count("content").alias("n")).where("n > 1").select(F.col("bucket").alias("ob"), F.col("window").alias("ow"))
    across = single.where("until > begin").join(across, (F.col("bucket") == F.col("ob")) & (F.col("window") == F.col("ow"))).select("bucket", "content", "begin", "until")
    out = stage(placed(pieces, whole(known).union(here).union(across)).select("key", "s.a", "s.b"), "span-inside")
    unstage(pieces, known, found)
    return out


def sharing(hot: DataFrame, passage: int) -> DataFrame:
    """bucket, content of each of these pieces (of buckets with very many kinds) that has a window of `passage` bytes in
    common with another document. The pieces are dealt out again by a longer gram; where a bucket still has too many kinds
    for one task, a row of each window's hash is counted."""
    parts = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.xxhash64("bucket", "content")
    texts = hot.where(windows_in(1) > 0).select(own.alias("key"), F.expr("piece").substr(windows_from(1) + 1, windows_in(1) + (passage - 1)).alias("raw"))
    inner = stage(find_pieces(texts, passage, None, int(LONG_GRAM * passage)), "share-inner")
    places = inner.join(hot.select(own.alias("of"), "lo", "hi"), F.col("key") == F.col("of"))
    kinds = stage(places.groupBy("bucket", "content", "shape").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("key").alias("key"), F.min_by("start", "key").alias("start")), "share-kinds")
    alone = F.max(F.when(F.col("lo") == F.col("hi"), 1).otherwise(0)) == 1
    mixed = kinds.groupBy("bucket").agg(F.count("content").alias("kinds"), ((F.min("lo") < F.max("hi")) & alone).alias("open")).where("open AND kinds > 1").select(F.col("bucket").alias("b"), "kinds")
    # the inner pieces' windows are those of `passage` bytes
    shape = F.shiftleft("shape", 2 * SHAPE).alias("shape")
    wanted = kinds.join(mixed, F.col("bucket") == F.col("b")).select("bucket", "content", shape, "key", "lo", "hi", "start", piece_bytes(passage, None).alias("size"), (F.col("kinds") > PIECES).alias("many"), F.lit(0).alias("block"))
    wanted = stage(wanted, "share-wanted")
    held = stage(texts_of(texts, wanted), "share-texts")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, piece in enumerate(b.column("piece")):
                h = np.unique(Rolling(np.frombuffer(piece.as_py(), np.uint8)).every(passage))
                columns = [pa.array(np.full(len(h), b.column(c)[r].as_py())) for c in ("bucket", "content", "lo", "hi")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(h.view(np.int64))], names=["bucket", "content", "lo", "hi", "window"])

    rows = stage(held.where("many").select("bucket", "content", "lo", "hi", "piece").mapInArrow(tidy(windows), "bucket long, content long, lo long, hi long, window long"), "share-windows")
    twice = rows.groupBy("bucket", "window").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most")
    twice = stage(twice.select(F.col("bucket").alias("wb"), F.col("window").alias("ww")), "share-twice")
    met = rows.where("lo = hi").join(twice, (F.col("bucket") == F.col("wb")) & (F.col("window") == F.col("ww"))).select("bucket", "content")
    met = met.union(sort_buckets(held.where("NOT many"), passage, parts, passage).select("bucket", "content")).union(kinds.where("lo < hi").select("bucket", "content"))
    met = stage(met.distinct().select(F.col("bucket").alias("mb"), F.col("content").alias("mc")), "share-met")
    keys = inner.join(met, (F.col("bucket") == F.col("mb")) & (F.col("content") == F.col("mc"))).select("key").distinct()
    out = stage(hot.select("bucket", "content", own.alias("of")).join(keys, F.col("key") == F.col("of")).select("bucket", "content"), "share-pieces")
    unstage(inner, kinds, wanted, held, rows, twice, met)
    return out


def repeated_spans(docs: DataFrame, width: int, passage: int | None) -> DataFrame:
    """key, spans, shared: for each document (key, raw) with any, the runs of window starts that occur elsewhere too, and 1
    if it has a string of `passage` bytes in common with another, else 0.

    All documents of a piece that several have share its passages. Of others the pieces of a bucket are compared.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = stage(find_pieces(docs, width, passage, GRAM), "span-pieces")
    known = known_kinds(pieces)
    repeats = (F.col("long_kinds") > 1) & (windows_in(0) > 0)
    wanted = known.where("kinds > 1").where(repeats | F.col("open") if passage else repeats)
    # windows that meet none of another piece are left out of the shape
    low = (1 << 2 * SHAPE) - 1
    shape = F.when(F.col("long_kinds") > 1, F.col("shape").bitwiseAND(F.lit(low))).otherwise(0).bitwiseOR(F.when(F.col("open"), F.col("shape").bitwiseAND(F.lit(~low))).otherwise(0)).alias("shape")
    wanted = stage(wanted.select("bucket", "content", shape, "key", F.col("key").alias("lo"), "hi", "start", piece_bytes(width, passage).alias("size"), (F.col("kinds") > PIECES).alias("many"), F.lit(0).alias("block")), "span-wanted")
    held = stage(texts_of(docs, wanted), "span-texts")
    marks = whole(known).union(sort_buckets(held.where("NOT many"), width, parts, passage).select("bucket", "content", "begin", "until"))
    # a piece of a hot bucket is a text of its own, that of its windows of `width` bytes
    hot = held.where("many")
    own = F.xxhash64("bucket", "content")
    inside = inside_pieces(hot.where(windows_in(0) > 0).select(own.alias("key"), F.expr("piece").substr(windows_from(0) + 1, windows_in(0) + (width - 1)).alias("raw")), width)
    names = hot.select("bucket", "content", windows_from(0).alias("first"), own.alias("of"))
    marks = marks.union(inside.join(names, F.col("key") == F.col("of")).select("bucket", "content", F.col("first") + F.col("a"), F.col("first") + F.col("b")))
    made = [inside]
    if passage:
        made.append(met := sharing(hot, passage))
        several = known.where((F.col("key") < F.col("hi")) & (windows_in(1) > 0)).select("bucket", "content")
        marks = marks.union(met.union(several).select("bucket", "content", F.lit(None).cast("int"), F.lit(None).cast("int")))
    spans = placed(pieces, marks).groupBy("key").agg(F.collect_set("s").alias("spans"), F.max("shared").cast("int").alias("shared"))
    spans = stage(spans, "span-spans")
    unstage(pieces, known, wanted, held, *made)
    return spans


def covered(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that the windows of these runs of starts (from a to b) cover."""
    b = b + width - 1
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, width: int = 400, keep_text: bool = False, carried: tuple[str, ...] = ("doc_id",), passage: int | None = None) -> DataFrame:
    """docs' carried columns with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay)
    and shared (1 if the text has a string of `passage` bytes that another document has too, else 0).

    Texts are read whole as UTF-8 bytes, null as empty. Each byte is removed that lies in a string of `width` bytes which
    also starts at another place of any text, the same one included; overlaps count, strings are judged on the input,
    and no string crosses documents. Texts shorter than width lose nothing; very long ones are cut into pieces like
    others. Rows of equal doc_id and text are two places each, so both lose what they share, but one document for
    `shared`. An empty table gives no rows; columns that aren't carried are ignored, whatever their names.

    Windows of `width` bytes, and of `passage` bytes with them, are dealt out by the gram of least hash in them, so equal
    windows meet, and neighbouring windows travel as one piece. Equal pieces are counted, not moved. Of a bucket whose
    pieces differ, one of each kind goes into a suffix array of a bounded text, of the suffixes that begin a window, and
    the hashes of its passages are compared; those of a bucket with too many kinds for one are first dealt out again by a
    longer gram, and if a bucket still has too many it is split into blocks, whose distinct windows are matched by a hash.
    """
    mine = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.xxhash64("doc_id", "text").alias("key"), F.encode("text", "UTF-8").alias("raw"))
    spans = repeated_spans(mine.select("key", "raw"), width, passage)
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "key"))
    n, names = len(carried), [f"c{i}" for i in range(len(carried))]

    def cut(raw: bytes | None, found: tuple[np.ndarray, np.ndarray] | None) -> tuple:
        null, raw = raw is None, raw or b""
        kept = raw
        a = ()
        if found:
            a, b = covered(*found, width)
            kept = b"".join(raw[x:y] for x, y in zip(np.append(0, b).tolist(), np.append(a, len(raw)).tolist()))
        return len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore").encode() if keep_text and not null else None

    def result(columns: list[pa.Array], done: list[tuple], shared: pa.Array) -> pa.RecordBatch:
        made = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*columns, *made, shared], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "shared"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~in_filter(bits.value, np.asarray(b.column("slot")))))
            yield result(b.columns[:n], [cut(r.as_py(), None) for r in b.column("raw")], pa.array(np.zeros(len(b), np.int32)))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(bits.value, np.asarray(b.column("slot"))))).drop_columns(["slot"])

    def with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            flat, ends = spans.flatten(), np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(spans), 0))).tolist()
            begin, until = (flat.field(f).to_numpy().astype(np.int64) for f in ("a", "b"))
            found = [(begin[x:y], until[x:y]) if x < y else None for x, y in zip(ends, ends[1:])]
            yield result(b.columns[:n], [cut(r.as_py(), s) for r, s in zip(b.column("raw"), found)], b.column("shared"))

    raw = mine.select(*names, "key", filter_slot("key").alias("slot"), "raw")
    ddl = ", ".join(f"{c} {raw.schema[c].dataType.simpleString()}" for c in names)
    clear = raw.mapInArrow(tidy(without), f"{ddl}, {_CUT}, shared int")
    rest = raw.mapInArrow(tidy(maybe), f"{ddl}, key long, raw binary").join(spans.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    shared = F.coalesce("shared", F.lit(0)) if passage else F.lit(0)
    rest = rest.select(*names, "raw", "spans", shared.cast("int").alias("shared")).mapInArrow(tidy(with_spans), f"{ddl}, {_CUT}, shared int")
    out = clear.union(rest).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "shared")
    return out.drop(*([] if keep_text else ["kept"]), *([] if passage else ["shared"]))


#: Bytes of a passage of over fifty words, or somewhat fewer.
PASSAGE = 280


def op3_repeated_spans(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and shared: 1 if another document has 280 bytes of the text too,
    about fifty words, even if they are fewer than are removed. Odd rows are treated as remove_repeats() says."""
    return remove_repeats(read(spark, sf_dir, "documents"), passage=PASSAGE)


def without_repeats(docs: DataFrame, width: int = PASSAGE) -> DataFrame:
    """docs with the kept bytes as text; columns as before. Of a character that a cut has split, the rest goes too; a null
    text stays null. Other odd rows are treated as remove_repeats() says."""
    others = tuple(c for c in docs.columns if c != "text")
    found = remove_repeats(docs, width, keep_text=True, carried=others)
    return found.withColumn("text", F.col("kept").cast("string")).select(*docs.columns)
