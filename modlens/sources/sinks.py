"""Readers and writers of the store's exchange formats."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.functions.text import csv_guard

MOST_BODY = 64 << 20


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def export_rows(df: DataFrame, score: str = "score", times: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """df as text columns for a CSV: times in RFC 3339, scores with four decimals, texts guarded against formulas."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name in times:
            c = rfc3339(c)
        elif name == score:
            c = F.when(c.isNotNull(), F.format_string("%.4f", c))
        elif kind == "string":
            c = csv_guard(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV for spreadsheets: each file begins with a byte order mark, as part of its header."""
    rows = export_rows(df)
    rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]).write.option("header", True).option("escape", '"').csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def metric_lines(df: DataFrame, name: str, labels: tuple[str, ...], value: str) -> DataFrame:
    """Lines of the text exposition format: name{label="value",...} number."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.coalesce(F.col(x), F.lit("")), F.lit('"')) for x in labels])
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def request_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies of a folder of JSON lines: path, agent, encoding, body (binary)."""
    return spark.read.schema("path string, agent string, encoding string, body binary").json(path)


def inflate_body(body: bytes | None, encoding: str | None) -> bytes | None:
    """The decompressed body; null if it is over MOST_BODY bytes, of which no more are made, or broken."""
    if body is None:
        return None
    try:
        if encoding in ("gzip", "deflate"):
            out, rest = bytearray(), body
            while rest and len(out) <= MOST_BODY:  # a gzip body may have several members
                inflater = zlib.decompressobj(31 if encoding == "gzip" else 15)
                out += inflater.decompress(rest, MOST_BODY + 1 - len(out))
                if len(out) <= MOST_BODY and not inflater.eof:
                    return None
                rest = inflater.unused_data if encoding == "gzip" else b""
            body = bytes(out)
        elif encoding == "zstd":
            import zstandard

            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=MOST_BODY + 1)
        elif encoding:
            return None
    except Exception:  # any codec's error means a broken body
        return None
    return body if len(body) <= MOST_BODY else None


@F.pandas_udf(T.BinaryType())
def decompressed(body: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([inflate_body(b, e) for b, e in zip(body, encoding)])
