"""Pieces that hold the windows of two widths, and suffix arrays of the starts of windows alone."""

from __future__ import annotations

import random

import numpy as np

from modlens.llm import dedup_spans, suffixes


def test_one_piece_for_both_widths():
    rng = random.Random(3)
    say = lambda n: bytes(rng.choice(b"abcdef ") for _ in range(n))
    rows = [say(2000), b"", say(350), say(63), say(400), b"x" * 900, say(5000)]
    data, ends = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0] + [len(r) for r in rows])
    for width, passage in ((400, 280), (280, 400), (300, 300), (400, None)):
        row, start, shape, bucket, content = dedup_spans.cut_pieces(data, ends, width, passage)
        small = min(width, passage or width)
        assert len(row) == len(dedup_spans.cut_pieces(data, ends, small)[0])  # no more than the smaller windows alone have
        first, k, passage_first, n = dedup_spans.shape_of(shape)
        assert passage or not n.any()
        for w, a, many in ((width, first, k), (passage, passage_first, n))[: 2 if passage else 1]:
            got = sorted((r, s) for r, s, m in zip(row, start + a, many) for s in range(s, s + m))
            assert got == [(r, s) for r, text in enumerate(rows) for s in range(len(text) - w + 1)]
        for alone in range(len(rows)):  # what stands around a row doesn't matter
            text = np.frombuffer(rows[alone], np.uint8)
            mine = dedup_spans.cut_pieces(text, np.array([0, len(text)]), width, passage)
            assert [x.tolist() for x in mine[1:]] == [x[row == alone].tolist() for x in (start, shape, bucket, content)]


def test_suffixes_of_wanted_starts():
    rng = np.random.default_rng(5)
    for symbols in (1, 2, 3):
        for _ in range(40):
            text = rng.integers(0, symbols, int(rng.integers(1, 90)), dtype=np.uint8)
            wanted = rng.random(len(text)) < 0.3
            order = suffixes.suffix_array(text, 20, wanted)
            assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
            heads = [text.tobytes()[i : i + 20] for i in order]
            assert heads == sorted(heads)
            whole = order[order <= len(text) - 20]
            assert suffixes.share_start(text, whole, 20).tolist() == (suffixes.common_prefixes(text, whole, 20) >= 20).tolist()


def test_passages_in_hot_buckets(spark, monkeypatch):
    """A line in many documents: 280 bytes around it that two of them share are told whichever way they are found, 279 are not."""
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, wide = say(70), say(230)
    docs = [say(260) + line + say(260) for _ in range(12)] + [say(90) + wide + say(90) for _ in range(12)]
    docs += [say(150) + docs[i][120:400] + say(150) for i in range(4)] + [say(150) + docs[i][60:340] + say(150) for i in range(12, 16)]
    docs += [say(149) + "1" + docs[i][120:399] + "2" + say(149) for i in range(4, 8)]
    want = {*range(4), *range(12, 16), *range(24, 32)}
    for block in (1, 4, 384):
        monkeypatch.setattr(dedup_spans, "PIECES", block)
        got = dedup_spans.remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), passage=280).collect()
        assert {r["doc_id"] for r in got if r["shared"]} == want
        assert not any(r["n_removed"] for r in got)
