"""Benchmark passages from anywhere in an item."""

from __future__ import annotations

import random

from modlens.llm import decontamination


def test_excerpts_at_every_offset(spark):
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(0, say(330)), (1, say(181)), (2, say(99))]
    docs, want = [], {}
    for i, item in items[:2]:
        for n, edits in ((100, 0), (100, 1), (100, 9), (110, 0), (120, 0), (99, 0)):
            for a in range(0, len(item) - n + 1, 3 if edits else 1):
                part = list(item[a : a + n])
                for at in range(10, 10 * edits + 1, 10):
                    part[at] = "0"
                if n >= 100:
                    want[len(docs), i] = edits
                docs.append(say(40) + "1" + "".join(part) + "2" + say(40))
    # one letter less on each side is 2 edits at the most, and those of 99 bytes are of a window with one edit
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.find_passages(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    short = {k: e for k, e in got.items() if k not in want}
    assert {k: got.get(k) for k in want} == want
    assert len(short) == len(docs) - len(want) and set(short.values()) == {1}
