"""Column functions of prompt texts: normal form, content hash, fingerprints, SimHash, envelopes."""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_RISKY = ("=", "+", "-", "@", "\t", "\r")


def normalise(text: Column) -> Column:
    """LF line ends, NUL as U+FFFD, no Unicode white space at the ends."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\\x00", "�")
    space = r"[\s\u0085\p{Z}]+"
    return F.regexp_replace(F.regexp_replace(t, f"^{space}", ""), f"{space}$", "")


def content_hash(kind: Column, text: Column) -> Column:
    return F.sha2(F.concat(kind, F.char(F.lit(0)), text).cast("binary"), 256)


def turn_fingerprint(instructions: Column, user: Column) -> Column:
    """sha-256 of the compact JSON of the ordered instruction hashes and the user hash."""
    return F.sha2(F.to_json(F.struct(instructions.alias("instructions"), F.coalesce(user, F.lit("")).alias("user"))), 256)


def turn_key(api_key_id: Column, fingerprint: Column) -> Column:
    return F.concat_ws(":", api_key_id.cast("string"), fingerprint)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def csv_guard(text: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(F.left(text, F.lit(1)).isin(*CSV_RISKY), F.concat(F.lit("'"), text)).otherwise(text)


def open_envelope(text: Column) -> Column:
    """Text that was stored as {"encoding": "utf8" or "base64", "data": ...}; other text passes through."""
    encoding, data = F.get_json_object(text, "$.encoding"), F.get_json_object(text, "$.data")
    return F.when(encoding == "utf8", data).when(encoding == "base64", F.coalesce(F.try_to_binary(data, F.lit("base64")).cast("string"), text)).otherwise(text)


def to_envelope(text: str) -> str:
    """The stored form of a text: as it is, or in an envelope if it holds NUL or looks like one."""
    if "\x00" in text or text.lstrip().startswith('{"encoding"'):
        return json.dumps({"encoding": "base64", "data": base64.b64encode(text.encode()).decode()}, separators=(",", ":"))
    return text


_EAST = r"ぁ-ゖゝ-ゟァ-ヺヽ-ヿㇰ-ㇿｦ-ｯｱ-ﾝ⺀-⺙⺛-⻳⼀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-舘並-龎\U00020000-\U000323af"
_FEATURE = re.compile(rf"(?P<east>[{_EAST}])|(?P<word>(?:[^\W_⺀-\U0010ffff]|[\d_-])+)")


def features(text: str) -> list[str]:
    """Lower-cased words of alphabetic letters, digits, _ and -; of Han and Kana each character and each pair of neighbours."""
    low, out = text.lower(), []
    east = re.compile(rf"[{_EAST}]")
    for m in _FEATURE.finditer(low):
        out.append(m[0])
        if m["east"] and m.end() < len(low) and east.match(low[m.end()]):
            out.append(low[m.start() : m.end() + 1])
    return out


def fnv1a(tokens: list[str]) -> np.ndarray:
    """FNV-1a of each token, all tokens a byte at a time."""
    raw = [t.encode() for t in tokens]
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    size = np.array([len(r) for r in raw])
    data = np.zeros((len(raw), size.max() if len(raw) else 0), np.uint8)
    for i, r in enumerate(raw):
        data[i, : len(r)] = np.frombuffer(r, np.uint8)
    for k in range(data.shape[1]):
        on = size > k
        h[on] = (h[on] ^ data[on, k]) * np.uint64(0x100000001B3)
    return h


def simhash(text: str | None) -> int | None:
    """64 bits, each set if more features have it than not; 0 for a text without features, null for null."""
    if text is None:
        return None
    tokens = features(text)
    if not tokens:
        return 0
    h = fnv1a(tokens)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return int(np.packbits(2 * ones.astype(int) > len(tokens), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash64(text: pd.Series) -> pd.Series:
    return text.map(simhash, na_action="ignore").astype("Int64")
