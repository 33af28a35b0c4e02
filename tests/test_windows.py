"""Flights, breakers between operators' acts, forms and the pair view against loops, Python's own parser and a plain LCS."""

from __future__ import annotations

import random
from email import message_from_bytes
from email.policy import HTTP
from functools import cache

import pytest
from pyspark.sql import functions as F

from modlens.functions import requests
from modlens.plans import boards, registry
from modlens.sources.tables import Tables
from modlens.streaming import folds

SF = "/root/testdata/sf0.001"


def flights(*rows):
    state, out = {}, []
    for i, at, ends, after in rows:
        state, made = folds.join_flights(state, {"id": i, "place": 1, "at": at, "ends": ends, "reuse_after": after})
        out += [f"{'joins' if m['inflight'] else 'starts'} {m['scored_by']}" for m in made]
    return out


def test_flights():
    assert flights((1, 0, 10, None), (2, 5, 30, None), (3, 10, 20, None), (4, 12, 40, None)) == ["starts 1", "joins 1", "starts 3", "joins 3"]
    # a repeated audit joins what started after it was asked for only; it takes the place of an older flight
    assert flights((1, 0, 100, None), (2, 5, 50, 4), (3, 6, 60, 5), (4, 7, 70, None)) == ["starts 1", "starts 2", "joins 2", "joins 2"]
    # when the older job ends, the newer flight is gone too
    assert flights((1, 0, 10, None), (2, 5, 50, 4), (3, 9, 60, None), (4, 11, 70, None), (5, 12, 80, None)) == ["starts 1", "starts 2", "joins 2", "starts 4", "joins 4"]


@pytest.mark.parametrize("seed", range(3))
def test_operated_breakers_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), rng.randrange(5), i, rng.randrange(40), "") if rng.random() < 0.8 else (rng.randrange(4), None, i, rng.randrange(40), rng.choice(["trust", "untrust", "confirm"])) for i in range(150)]
    want, state = [], {}
    for h, user, i, at, event in sorted(rows, key=lambda r: (r[0], r[3], r[4] == "", r[2], r[1] or 0)):
        s, made = folds.break_circuit(state.get(h, {}), {"hash_key": h, "user_id": user, "job_id": i, "event": event})
        state[h] = s
        want += [tuple(m[k] for k in ("hash_key", "user_id", "job_id", "outcome", "status", "users")) for m in made]
    df = spark.createDataFrame(rows, "hash_key long, user_id long, job_id long, at long, event string")
    assert sorted(tuple(r) for r in registry.operated_breakers(df).collect()) == sorted(want)
    assert registry.operated_breakers(df.limit(0)).count() == 0


def form(*parts, end="\r\n", close=True, boundary="XX"):
    lines = [b"preamble"]
    for head, content in parts:
        lines += [b"--" + boundary.encode(), *[h.encode() for h in head], b"", content]
    return end.encode().join([*lines, *([b"--" + boundary.encode() + b"--", b"epilogue"] if close else [])])


TEXT = ("Content-Disposition: form-data; name=\"a\"", "Content-Type: text/plain")


def test_forms(spark):
    bodies = [
        form((TEXT, b"one\r\n--X two\r\n"), (["content-disposition: form-data; name=b"], "é\U0001f600".encode()), (["Content-Disposition: form-data; name=\"f\"; filename=\"x.png\""], b"\x89PNG"), (["Content-Disposition: form-data; name=\"g\"; filename=\"\""], b"kept"), (TEXT, b"\xff\xfe"), (["X: y"], b"no name"), ([], b"no head")),
        form((TEXT, b"bare\nlines"), end="\n"),
        form((TEXT, b"not closed"), close=False),
        form(),
        form((TEXT, b"x" * 300_000)),
        form((TEXT, b"other"), boundary="YY"),
        b"",
        None,
    ]
    df = spark.createDataFrame([(i, b if b is None else bytearray(b)) for i, b in enumerate(bodies)], "i int, body binary")
    got = {r["i"]: None if r["f"] is None else [tuple(x) for x in r["f"]] for r in df.select("i", requests.form_texts(F.col("body"), F.lit("XX")).alias("f")).collect()}
    assert got == {
        0: [("a", "one\r\n--X two\r\n"), ("b", "é\U0001f600"), ("g", "kept"), ("", "no name"), ("", "no head")],
        1: [("a", "bare\nlines")],
        2: None,
        3: [],
        4: [("a", "x" * 300_000)],
        5: None,
        6: None,
        7: None,
    }
    parsed = message_from_bytes(b"Content-Type: multipart/form-data; boundary=XX\r\n\r\n" + bodies[0], policy=HTTP)
    assert [p.get_payload(decode=True) for p in parsed.iter_parts()][:2] == [t.encode() for _, t in got[0][:2]]
    assert df.select(requests.form_texts(F.col("body"), F.lit("")).alias("f")).where("f IS NOT NULL").count() == 0


def test_pair_view(spark):
    t = Tables(spark, SF)
    rows = boards.similar_pair(t).collect()
    near = {}
    for r in boards.similar_prompts(t).collect():
        near[r["b"]] = min(near.get(r["b"], (99, 0)), (r["distance"], r["a"]))
    texts = {r["id"]: r["text"] for r in t.prompts.collect()}
    assert {(r["b"], r["distance"], r["a"]) for r in rows} == {(b, *x) for b, x in near.items()} and near
    for b, (_, a) in near.items():
        x, y = texts[a].split("\n"), texts[b].split("\n")

        @cache
        def common(i, j, x=x, y=y):
            if i == len(x) or j == len(y):
                return 0
            return 1 + common(i + 1, j + 1) if x[i] == y[j] else max(common(i + 1, j), common(i, j + 1))

        mine = sorted((r for r in rows if r["b"] == b), key=lambda r: r["place"])
        gone, new = [r for r in mine if r["op"] == "del"], [r for r in mine if r["op"] == "add"]
        if len(x) * len(y) <= 2500:
            assert (len(gone), len(new)) == (len(x) - common(0, 0), len(y) - common(0, 0))
        assert all(x[r["line_before"]] == r["text"] for r in gone) and all(y[r["line_after"]] == r["text"] for r in new)
        same = sum(int(r["text"]) if r["op"] == "skip" else 1 for r in mine if r["op"] in ("same", "skip"))
        assert same + len(gone) == len(x) and same + len(new) == len(y)
