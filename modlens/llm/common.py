"""Shared pieces of the training-data operators: staging, fixed-size filters, byte views, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: 2**26 bits, 8 MB whatever the input's size: the bound of every broadcast row filter.
FILTER_BITS = 26
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch: a task holds one at a time, so these bound what a Python worker takes.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Asks Spark for smaller Arrow batches in this session, unless it already makes some as small."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"\d+", spark.conf.get(name, None) or "")
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Returns memory that nothing uses any more to the system; a worker lives on after a task, and the driver after a fit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with its memory given back at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local one under a local master (tests), and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='modlens-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns the table: lineage ends here, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "staged_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def key_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with the hash of every value of a long column set; collisions only let more rows pass."""
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << FILTER_BITS))
    rows = (
        df.select(h.alias("h"))
        .groupBy(F.bitmap_bucket_number("h").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
        .collect()
    )
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        got = np.frombuffer(bytes(r["m"]), np.uint8)[: len(out) - at if at >= 0 else 0]
        if at >= 0:
            out[at : at + len(got)] = got
        else:  # bucket 0 holds the value 0 alone
            out[0] |= 1
    return out


def filter_slot(column: str) -> Column:
    """The bit of key_filter that a row's value looks at, as bitmap_construct_agg numbers it."""
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(1 << FILTER_BITS))
    return ((F.bitmap_bucket_number(h) - 1) * 32768 + F.bitmap_bit_position(h)).cast("long")


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = np.maximum(slots, 0)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def byte_chunks(column: pa.Array, limit: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes joined, offsets into those) with about `limit` bytes and at most `rows` rows each; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(wide)
    _, where, raw = wide.buffers()
    ends = np.frombuffer(where, np.int64)[wide.offset : wide.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
        b = min(b, n, a + rows)
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)


class Rolling:
    """Hashes of any substrings of one byte array, two array reads each."""

    def __init__(self, data: np.ndarray):
        _grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers[0][: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers[1][start])

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * _powers[1][:n]) if n > 0 else np.zeros(0, np.uint64)


#: Bytes 0x20 and 0x09 to 0x0D separate words.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each row has; a row's border ends a word."""
    letter = ~SPACE[data]
    prev = np.zeros(len(data), bool)
    prev[1:] = letter[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    prev[inner] = False
    starts = np.flatnonzero(letter & ~prev)
    after = np.zeros(len(data), bool)
    after[:-1] = letter[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(letter & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def append_columns(df: DataFrame, added: str, start) -> DataFrame:
    """df with the columns of the DDL text `added`; start() is called in each task and returns a function from an Arrow batch to the new columns' arrays."""
    new = T.StructType.fromDDL(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *make(b)], names=[*b.schema.names, *new.names])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, *new.fields]))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores what no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
