"""The trie of conversations against its SQL and against nested tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from modlens.llm import tries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for node, found in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = {x: [y for y in below if len(y) == len(x) + 1 and y[: len(x)] == x] for x in below}
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in below if x)
        ends = ",".join(str(c) for c in found if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), parent, len(found), len(children[node]), sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [
    (0, None, "user", "first by null"),
    (0, 1, None, None),
    (0, 1, None, None),
    (0, 2, "user", ""),
    (7, 0, "user", "a b c"),
    (None, 0, "user", "of nobody"),
    (-5, 0, "user", "a b c"),
    (-5, 0, "assistant", "tie"),
    (-20, 3, "u", "sera"),
    (-20, 3, "us", "era"),
    (45, 1, "user", "only own"),
    (46, 1, "user", "a b c"),
    (1000, 5, "user", "long " * 60_000),
    (1001, 5, "user", "long " * 60_000),
    (1002, 5, "user", "\U0001f600 é"),
    *((c, t, "user", f"turn {t % 3} \x0b said") for c in (60, 61, 62, 63, 80) for t in range(c % 7)),
    *((100 + c, 0, "user", "same") for c in range(40)),
]


def test_odd_conversations(spark):
    got = tries.prefix_trie(spark.createDataFrame(ODD, TURNS).selectExpr("*", "1 AS depth", "2 AS k1", "3 AS words", "4 AS at", "5 AS block", "6 AS digest"))
    assert rows_of(got) == brute(ODD)


def test_empty_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert tries.prefix_trie(none).count() == 0
    assert tries.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


@pytest.mark.parametrize(("parts", "seed"), [("1", 1), ("40", 2), ("13", 3)])
def test_conversations_across_parts(spark, monkeypatch, parts, seed):
    """A conversation of half of all turns, a common first turn, and lists of ends longer than a piece."""
    rng = random.Random(seed)
    monkeypatch.setattr(tries, "PIECE", 7)
    rows = [(20, t, "user", rng.choice("ab")) for t in range(300)] + [(21, t, "user", rng.choice("ab")) for t in range(30)]
    rows += [(c, t, rng.choice(["user", "assistant"]), "hello there" if t == 0 else rng.choice(["x", "y y", "z"])) for c in range(100, 190) for t in range(rng.randrange(1, 5))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows_of(tries.prefix_trie(spark.createDataFrame(rows, TURNS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(duck.sql(f"SELECT {', '.join(COLUMNS)} FROM ({tries.SQL})").fetchall(), key=repr)
    assert rows_of(tries.op12_conversation_trie(spark, SF)) == want
    assert want == brute(duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
