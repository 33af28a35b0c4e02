"""The scoring contract: one JSON object with confidence and reason."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"\A\s*```(?:json)?\s*\n(.*)\n\s*```\s*\Z", re.S)


def parse_score(text: str | None) -> dict:
    """confidence and reason, or error: not one JSON object (a code fence around it is allowed), a repeated key, a
    confidence that isn't a number in [0, 1], or a reason that isn't text."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("duplicate_key")
        return dict(pairs)

    bad = lambda code: {"confidence": None, "reason": None, "error": code}
    if text is None:
        return bad("empty")
    if m := _FENCE.match(text):
        text = m[1]
    try:
        got = json.loads(text, object_pairs_hook=unique)
    except ValueError as e:
        return bad("duplicate_key" if str(e) == "duplicate_key" else "invalid_json")
    if not isinstance(got, dict):
        return bad("invalid_json")
    c, reason = got.get("confidence"), got.get("reason")
    if isinstance(c, bool) or not isinstance(c, (int, float)) or not 0 <= c <= 1:
        return bad("invalid_confidence")
    if not isinstance(reason, str):
        return bad("invalid_reason")
    return {"confidence": float(c), "reason": reason, "error": None}


@F.pandas_udf(T.StructType([T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("error", T.StringType())]))
def score_contract(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_score(t) for t in text], columns=["confidence", "reason", "error"])
