"""Fingerprints: order, insertion and deletion, likeness, and the query against a plain walk over sorted documents."""

from __future__ import annotations

import hashlib
import random
from functools import cache
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modlens.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@cache
def word_hash(w):
    return int(fp.Rolling(np.frombuffer(w, np.uint8))(np.array([0]), np.array([len(w)]))[0])


@cache
def mixed(x):
    return int(fp.mix(np.array([x], np.uint64))[0])


@cache
def plain(text):
    """A fingerprint word by word: the sum of each line's digest, and a sign in a lane for each run of words."""
    of, lanes = 0, [0] * fp.LANES
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        if not words:
            continue
        of += int.from_bytes(hashlib.blake2b(line, digest_size=32).digest(), "little")
        for i in range(max(1, len(words) - fp.RUN + 1)):
            key = 0
            for k, w in enumerate(words[i : i + fp.RUN]):
                key = mixed((key + word_hash(w) + k + 1) % 2**64)
            lanes[(key >> 32) * fp.LANES >> 32] += 1 - 2 * (key & 1)
    return f"{of % 2**256:064x}" + "".join(f"{x % 2**fp.BITS:0{fp.BITS // 4}x}" for x in lanes)


TEXT = st.text(alphabet="ab é\n\t\U0001f600", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_against_word_by_word(texts):
    for t in texts:
        assert fp.fingerprint(t) == plain(t)
    parts = [fp.paragraphs(t.encode()) for t in texts]
    assert [fp.to_text(fp.digest(p), lanes) for p, lanes in zip(parts, fp.sketches(parts), strict=True)] == [plain(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(TEXT, TEXT, TEXT)
def test_paragraphs_go_in_and_out(a, b, c):
    assert fp.fingerprint(f"{a}\n{b}\n{c}") == fp.fingerprint(f"{c}\n{a}\n{b}")
    assert fp.changed(fp.fingerprint(f"{a}\n{b}"), out=[b], into=[c]) == fp.fingerprint(f"{a}\n{c}")
    assert fp.to_text(*fp.from_text(fp.fingerprint(a))) == fp.fingerprint(a)


def test_pieces_of_long_lines(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "x" * 40]) for _ in range(n)) for n in (1, 2, 3, 30, 200)] + ["y" * 90, " z" * 50, "  " + "q" * 70 + "  " + "r" * 70 + "\nend"]
    want = [fp.fingerprint(t) for t in texts]
    for chunk in (1, 7, 16, 64):
        monkeypatch.setattr(fp, "CHUNK", chunk)
        assert [fp.fingerprint(t) for t in texts] == want


def test_likeness_follows_what_is_shared():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]

    def lanes(t):
        return np.array([fp.digest(fp.paragraphs(t.encode()))], object), fp.sketches([fp.paragraphs(t.encode())])

    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        got = []
        for _ in range(20):
            a = [" ".join(rng.choices(words, k=12)) for _ in range(40)]
            b = a[: int(40 * share)] + [" ".join(rng.choices(words, k=12)) for _ in range(40 - int(40 * share))]
            got.append(fp.likeness(lanes("\n".join(a)), lanes("\n".join(reversed(b))))[0])
        assert abs(np.mean(got) - share) < 0.06 and max(abs(np.array(got) - share)) < 0.3
    assert fp.likeness(lanes(""), lanes("\n \n"))[0] == 1 and fp.likeness(lanes(""), lanes("a"))[0] == 0


def brute(rows):
    """What the query must give, from (doc_id, text) in order."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [plain(x) for x in (text, edited, after)]
        both = [fp.from_text(x) for x in prints]
        near = [float(fp.likeness((np.array([both[0][0]], object), both[0][1][None]), (np.array([x[0]], object), x[1][None]))[0]) for x in both[1:]]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], *near))
    return out


def in_order(spark, rows):
    keyed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").collect()
    return [(r["doc_id"], r["text"]) for r in sorted(keyed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]


def plainly(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_tables(spark):
    big = 2**60
    rows = [(None, "no id\nat all"), (None, None), (big + 1, "b" * 9), (big, "a\nb\nc"), (5, ""), (5, "five five"), (5, "five five"), (-3, "é\U0001f600" * 7), (6, "line\n" * 3_000), (7, ("w" * 999 + " ") * 2_500)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 AS h", "'x' AS part", "2 AS guest", "3 AS fingerprint")
    want = [brute(in_order(spark, rows))]
    got = fp.fingerprint_edits(docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert plainly(got) == sorted(want[0], key=repr)
    assert fp.fingerprint_edits(docs.limit(0)).count() == 0
    assert plainly(fp.fingerprint_edits(docs.where("doc_id = -3"))) == brute([rows[7]])
    assert fp.with_fingerprint(docs).columns[-1] == "fingerprint_" and fp.with_fingerprint(docs).where("doc_id = 6").first()["fingerprint_"] == plain(rows[8][1])


@pytest.mark.parametrize("parts", ["1", "50"])
def test_many_parts(spark, parts):
    rng = random.Random(1)
    rows = [(rng.randrange(60) if rng.random() < 0.6 else None, rng.choice(["", "a b c d", "one\ntwo", None, "x" * rng.randrange(30)])) for _ in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = plainly(fp.fingerprint_edits(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(brute(in_order(spark, rows)), key=repr)


def test_query_over_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    got = fp.op13_document_fingerprints(spark, SF).orderBy("doc_id").collect()
    assert len(rows) == len(got) == len({r["doc_id"] for r in got})
    want = brute(rows)
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5] and tuple(g)[5:] == pytest.approx(w[5:], abs=1e-12)
    assert np.mean([r["near_edited"] for r in got]) > 0.3 > 0.15 > np.mean([r["near_next"] for r in got])
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.95
    assert Path(SF).exists()
