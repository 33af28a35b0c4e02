"""Fingerprints of documents: a homomorphic multiset hash of their paragraphs.

A paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each lane modulo a
power of two. Sums don't depend on order, and a paragraph goes in or out by one addition or subtraction.

The first lane is a digest of 256 bits: two fingerprints with equal digests are of equal multisets of paragraphs. The
other LANES lanes of BITS bits count the paragraph's runs of three words with signs (a hash picks a lane and a sign for
each run), so that inner products of fingerprints estimate how much two documents share.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from modlens.llm.common import SPACE, Rolling, U, append_columns, free_name, mix, read, small_batches, stage, tidy, unstage, word_spans

LANES, BITS = 192, 24
MASK, WHOLE = (1 << BITS) - 1, 1 << 256
#: Words of a run, and bytes of text whose words are hashed at once.
RUN, CHUNK = 3, 1 << 20
#: Text of a partition of document_pairs, in bytes.
PART_BYTES = 128 << 20


def paragraphs(text: bytes) -> list[bytes]:
    """Lines of the text that hold anything but white space."""
    return [p for p in text.split(b"\n") if p.strip(b" \t\r\x0b\x0c")]


def digest(parts: Iterable[bytes]) -> int:
    return sum(int.from_bytes(hashlib.blake2b(p, digest_size=32).digest(), "little") for p in parts) % WHOLE


def _pieces(line: bytes) -> Iterator[bytes]:
    """A long line in pieces of about CHUNK bytes, RUN words at least, that end with a word; each begins with the last RUN - 1 words of the one before."""
    at = end = 0
    while True:
        end = min(len(line), end + CHUNK)
        while end < len(line) and not SPACE[line[end]]:
            end += 1
        if end == len(line):
            yield line[at:]
            return
        words = line[at:end].rstrip().rsplit(None, RUN - 1)
        if len(words) < RUN:
            continue  # the next piece begins later than this one only if this one has more words than are seen again
        yield line[at:end]
        back = end
        for _ in range(RUN - 1):
            while SPACE[line[back - 1]]:
                back -= 1
            while not SPACE[line[back - 1]]:
                back -= 1
        at = back


def _runs(data: np.ndarray, offsets: np.ndarray, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of RUN words in one line, and of each shorter line if `short`."""
    starts, ends, words = word_spans(data, offsets)
    row = np.repeat(np.arange(len(words)), words)
    line = np.cumsum(data == 10)[starts] if len(starts) else starts
    line = line + row  # a row's border ends a line
    h, n = Rolling(data)(starts, ends), len(starts)
    key, length = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(min(RUN, n)):
        same = np.zeros(n, bool)
        same[: n - k] = (line[k:] == line[: n - k]) & (length[: n - k] == k)
        key[same] = mix(key[same] + h[np.flatnonzero(same) + k] + U(k + 1))
        length[same] += 1
    take = length == RUN
    if short and n:
        take[0] = True
        take[1:] |= line[1:] != line[:-1]
    return row[take], key[take]


def sketches(texts: list[list[bytes]]) -> np.ndarray:
    """The signed counts of runs of three words within a paragraph, a row for each list of paragraphs; a paragraph of fewer words is one run.
    About CHUNK bytes are worked on at a time."""
    out = np.zeros((len(texts), LANES), np.int64)

    def count(rows: np.ndarray, key: np.ndarray) -> None:
        lane = ((key >> U(32)) * U(LANES) >> U(32)).astype(np.int64)
        out.ravel()[:] += np.bincount(rows * LANES + lane, 1.0 - 2.0 * (key & U(1)), out.size).astype(np.int64)

    ids: list[int] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            offsets = np.zeros(len(held) + 1, np.int64)
            np.cumsum([len(t) for t in held], out=offsets[1:])
            row, key = _runs(np.frombuffer(b"".join(held), np.uint8), offsets)
            count(np.asarray(ids)[row], key)
        ids.clear()
        held.clear()
        size = 0

    for i, parts in enumerate(texts):
        for p in parts:
            if len(p) > CHUNK:
                found = 0
                for piece in _pieces(p):
                    row, key = _runs(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), short=False)
                    count(row + i, key)
                    found += len(row)
                if not found:
                    row, key = _runs(np.frombuffer(p, np.uint8), np.array([0, len(p)]))
                    count(row + i, key)
                continue
            ids.append(i)
            held.append(p)
            size += len(p)
            if size >= CHUNK:
                flush()
    flush()
    return out


def to_text(of_digest: int, lanes: np.ndarray) -> str:
    """A fingerprint as hexadecimal digits: the digest's 64, then BITS / 4 for each lane."""
    low = (lanes & MASK).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - BITS // 8 :]
    return f"{of_digest:064x}" + low.tobytes().hex()


def from_text(text: str) -> tuple[int, np.ndarray]:
    """The digest and the lanes, as numbers from -2**(BITS - 1) on."""
    raw = np.frombuffer(bytes.fromhex(text[64:]), np.uint8).reshape(-1, BITS // 8).astype(np.int64)
    lanes = np.zeros(len(raw), np.int64)
    for k in range(BITS // 8):
        lanes = lanes << 8 | raw[:, k]
    return int(text[:64], 16), lifted(lanes)


def lifted(lanes: np.ndarray) -> np.ndarray:
    return ((lanes + (1 << (BITS - 1))) & MASK) - (1 << (BITS - 1))


def fingerprint(text: str | None) -> str:
    parts = paragraphs((text or "").encode("utf-8", "surrogatepass"))
    return to_text(digest(parts), sketches([parts])[0])


def changed(text: str, out: Iterable[str] = (), into: Iterable[str] = ()) -> str:
    """The fingerprint after paragraphs went out of and into its document, without a look at the document."""
    of, lanes = from_text(text)
    for sign, parts in ((-1, out), (1, into)):
        found = [p for x in parts for p in paragraphs(x.encode("utf-8", "surrogatepass"))]
        of, lanes = (of + sign * digest(found)) % WHOLE, lanes + sign * sketches([found])[0]
    return to_text(of, lanes)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Twice the runs that two documents share, by all that both have, from 0 to 1: 1 only for equal fingerprints.

    a, b: digests and lanes of many fingerprints, row by row. The estimate's standard deviation is about 1 / sqrt(LANES) of
    the documents' own size.
    """
    x, y = lifted(a[1]).astype(np.float64), lifted(b[1]).astype(np.float64)
    both = (x * x).sum(1) + (y * y).sum(1)
    near = np.clip(2 * (x * y).sum(1) / np.maximum(both, 1), 0.0, np.nextafter(1.0, 0.0))
    return np.where(a[0] == b[0], 1.0, near)


# --- documents beside their successors -----------------------------------------------------------------------------------


def document_pairs(docs: DataFrame, made: T.StructType, make) -> DataFrame:
    """Columns `made` for every document and the next one in the order of doc_id; the last one's next is the first.

    make(ids, texts, nexts) gets lists of a few documents (texts as str, null as "") and gives a record batch of `made`. Null
    ids come first; rows of one id follow each other by a hash of their text.

    The table is cut at documents (doc_id and hash of the text) into parts of about PART_BYTES; the document at a cut goes
    to the part before as well, as its last one's next. Texts are shuffled once, a part is sorted where it lies, and a task
    holds two documents beside its batch. The driver gets one id for each part, no texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = stage(kept.select("doc_id", "h", F.octet_length("text").alias("size")), "print-keys")
    size = keys.agg(F.sum("size")).first()[0]
    if size is None:
        return spark.createDataFrame([], made)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dealt = keys.select("doc_id", "h").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h")
    least = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("h"))).alias("k"))
    cuts = sorted((there, i if there else 0, h) for (there, i, h) in (r["k"] for r in least.collect()))
    unstage(keys)

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array, h: pa.Array) -> pa.Array:
        out = []
        for i, x in zip(ids.to_pylist(), h.to_pylist(), strict=True):
            key = (i is not None, 0 if i is None else i, x)
            at = bisect_right(cuts, key) - 1
            out.append([at, (at - 1) % len(cuts) + len(cuts)] if cuts[at] == key else [at])
        return pa.array(out, pa.list_(pa.int32()))

    place = F.explode(places(F.col("doc_id"), F.col("h")))
    rows = kept.withColumn("place", place).select("doc_id", "h", "text", F.pmod("place", F.lit(len(cuts))).cast("int").alias("part"), (F.col("place") >= len(cuts)).alias("guest"))
    rows = rows.repartitionById(len(cuts), F.col("part")).sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, over = None, False
        for b in batches:
            ids, texts, nexts = [], [], []
            for i, text, guest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if over:
                    break
                if before is not None:
                    ids.append(before[0])
                    texts.append(before[1])
                    nexts.append(text)
                before, over = (i, text), guest
            if ids:
                yield make(ids, texts, nexts)

    return rows.mapInArrow(tidy(run), made)


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of an edited text, and how alike they are: doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Edited: the last n_chars // 2 code points make way for as many of the next document's first ones, or all it has. The
    edited text's fingerprint is made from the document's own, by the paragraphs that went out and those that came in.
    near_edited and near_next are the likeness() of the document to its edited text and to the next document.

    Null texts are empty: the fingerprint of no paragraphs, alike to itself only. Null ids come first; rows of one id are in
    the order of a hash of their texts. A document alone is its own next one. Texts are read whole, whatever their length.
    Other columns are ignored, and an empty table gives an empty one.
    """
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    made = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(COLUMNS).fields])
    arrow = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def make(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        # the first text and all nexts, each once: texts[i + 1] is nexts[i]
        whole = [paragraphs(t.encode("utf-8", "surrogatepass")) for t in [texts[0], *nexts]]
        out, into, hashes = [], [], []
        for i, (t, after) in enumerate(zip(texts, nexts, strict=True)):
            half = len(t) // 2
            edited = (t[: len(t) - half] + after[:half]).encode("utf-8", "surrogatepass")
            hashes.append(hashlib.sha256(edited).hexdigest())
            mine, new = whole[i], paragraphs(edited)
            same = 0
            for p, q in zip(mine, new, strict=False):
                if p != q:
                    break
                same += 1
            out.append(mine[same:])
            into.append(new[same:])
        n = len(texts)
        lanes = sketches([*whole, *out, *into])
        own, lost, got = lanes[: n + 1], lanes[n + 1 : 2 * n + 1], lanes[2 * n + 1 :]
        digests = [digest(p) for p in whole]
        edited_digests = [(d - digest(o) + digest(i)) % WHOLE for d, o, i in zip(digests, out, into, strict=False)]
        edited_lanes = own[:n] - lost + got
        d = np.array(digests, object)
        near = [likeness((d[:n], own[:n]), (np.array(edited_digests, object), edited_lanes)), likeness((d[:n], own[:n]), (d[1:], own[1:]))]
        prints = [to_text(x, y) for x, y in zip(digests[:n], own, strict=False)]
        edited_prints = [to_text(x, y) for x, y in zip(edited_digests, edited_lanes, strict=True)]
        made_of = [[len(t) for t in texts], hashes, prints, edited_prints, *near]
        columns = [pa.array(ids, kind), *(pa.array(c, f.type) for c, f in zip(made_of, arrow, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *arrow.names])

    return document_pairs(docs, made, make)


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text (null: empty) as a column `name`, or one with underscores added if there is such a column."""
    at = docs.columns.index("text")

    def start():
        def make(b: pa.RecordBatch) -> list[pa.Array]:
            parts = [paragraphs((t or "").encode("utf-8", "surrogatepass")) for t in b.column(at).to_pylist()]
            return [pa.array([to_text(digest(p), lanes) for p, lanes in zip(parts, sketches(parts), strict=True)], pa.string())]

        return make

    return append_columns(docs, f"{free_name(docs, name)} string", start)


def op13_document_fingerprints(spark, sf_dir):
    return fingerprint_edits(read(spark, sf_dir, "documents"))
