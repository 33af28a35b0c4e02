"""The filter audit against its SQL, and against every document taken through every order."""

from __future__ import annotations

import re
from itertools import permutations

import duckdb
import pandas as pd
import pytest

from modlens.llm import audit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    last = float("inf")
    parts = {}
    for i, text, _, source, _ in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            bad.add("C")
        if set(text) & set("#$%&*|"):
            bad.add("D")
        if any((last if j is None else j) < (last if i is None else i) for j, t, *_ in docs if (t or "") == text):
            bad.add("E")
        parts.setdefault(source or "", []).append((bad, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        made, first = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                goes, stays = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                first[x] += len(goes)
                failing = sum(x in r[0] for r in rows)
                made.append((x, [part, "".join(order), step, len(stays), len(goes), failing - len(goes), sum(r[0] == {x} for r in rows), sum(r[1] for r in goes), sum(r[2] for r in goes)]))
                left = stays
        out += [(*row, first[x]) for x, row in made]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


LONG = " ".join(f"w{i}" for i in range(200))
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, LONG, "en", "a", 0),
    (3, LONG, "en", "a", 0),
    (4, LONG, "en", None, 0),
    (None, LONG, "en", "", 0),
    (None, "alone #", "en", "b", 0),
    (None, "alone #", "en", "b", 0),
    (5, "Ünïcode \U0001f600 É" * 30, "en", "b", 0),
    (6, LONG + " $5", "en", "b", 0),
    (7, "word " * 199 + "word", "en", "b", 0),
    (7, "A B C d", None, "b", None),
    (8, LONG.replace(" ", "\x0b"), "en", "c", 0),
    (9, LONG.replace(" ", "\xa0"), "en", "c", 0),
    (10, "x" * 300_000, "en", "c", 0),
    (11, "x" * 300_000, "en", "a", 0),
    (12, "AB" + "x" * 98, "en", "a", 0),
    (13, "ABC" + "x" * 97, "en", "a", 0),
]
MARKS = [(3, 1, 0), (3, 0, None), (4, 1, 1), (None, 1, 1), (7, None, 1), (11, 1, None), (11, 1, 1), (99, 1, 1)]


def test_every_order_by_hand(spark):
    got = audit.filter_interactions(spark.createDataFrame(ODD, DOCS), spark.createDataFrame(MARKS, LABELS))
    assert rows_of(got) == brute(ODD, MARKS)
    assert {c: t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == dict.fromkeys(COLUMNS[3:], "bigint")
    assert dict(got.dtypes)["step"] == "int"


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 AS part", "2 AS mask", "3 AS n", "4 AS digest", "5 AS quality", "6 AS toxic", "7 AS good", "8 AS step")
    labels = spark.createDataFrame(MARKS, LABELS).selectExpr("*", "'x' AS text", "'y' AS source", "9 AS salt")
    assert rows_of(audit.filter_interactions(docs, labels)) == brute(ODD, MARKS)
    assert rows_of(audit.filter_interactions(docs, labels.limit(0))) == brute(ODD, [])
    assert audit.filter_interactions(docs.limit(0), labels).count() == 0


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "", "s", 1), (2, "bb", "", "s", 1), (3, "a", "", "s", 1)], DOCS)
    got = audit.filter_interactions(docs, spark.createDataFrame([], LABELS), {"L": audit.F.length("text") > 1})
    assert sorted((r["filter_order"], r["step"], r["removed"], r["shapley"]) for r in got.collect()) == [("EL", 1, 1, 2), ("EL", 2, 1, 2), ("LE", 1, 1, 2), ("LE", 2, 1, 2)]


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_equals_its_sql(spark, size):
    at = SF.replace("sf0.001", size)
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = duck.sql(audit.SQL).df()
    got = audit.op11_filter_audit(spark, at).toPandas()
    assert len(got) == 600 * len(want["part"].unique())
    order = COLUMNS[:3]
    pd.testing.assert_frame_equal(got[COLUMNS].sort_values(order, ignore_index=True), want[COLUMNS].sort_values(order, ignore_index=True), check_dtype=False)
