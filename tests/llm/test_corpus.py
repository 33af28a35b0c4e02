"""Near-duplicates, repeated spans, passages, vectors, pages, tree scores, mixing: against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modlens.llm import ctw, decontamination, dedup_spans, graph, mixing, neardup, pages, suffixes, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components ------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union(links, {x for p in links if p[0] != p[1] for x in p})
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near-duplicates -------------------------------------------------------------------------------------------------


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return low.encode().split()


def shingles(text, width):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute_groups(docs, width, percent):
    sets = [shingles(t, width) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union(pairs, range(len(docs)))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted(((d, len(sets[i]), least.get(root[i])) for i, (d, _) in enumerate(docs)), key=str)


def planted(seed=1, groups=6, members=25):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    docs, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((n, " ".join(w)))
            n += 1
    docs += [(n + i, " ".join(rng.choice(vocabulary) for _ in range(80))) for i in range(40)]
    docs += [(5000, docs[0][1]), (5000, docs[0][1]), (5001, docs[0][1].upper()), (5002, None), (5003, ""), (5004, " \t\n"), (5005, "Two words"), (5006, "two  WORDS"), (None, docs[3][1]), (None, "alone of its kind"), (5007, " ".join(vocabulary) * 8)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, width, percent):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS node", "3 AS key")
    rows = neardup.near_duplicates(df, width, percent).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)
    assert got == brute_groups(docs, width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words in this text here"), (None, "x y z")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in neardup.one_of_each(docs).collect()) == ["1", "3", "None"]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(5)
    one = rng.integers(0, 2**63, 1000).astype(np.uint64)
    two = one.copy()
    two[:100] = rng.integers(0, 2**63, 100).astype(np.uint64)
    sk = neardup.sketches(np.concatenate([one, two, one[:1]]), np.array([1000, 1000, 1]))
    assert (sk != np.iinfo(np.uint64).max).all()
    assert (sk[0] == sk[1]).mean() == pytest.approx(900 / 1100, abs=0.09)


# --- suffix arrays and repeated spans -----------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.integers(1, 40))
def test_suffix_array_and_prefixes(symbols, depth):
    text = np.array(symbols, np.uint8)
    raw = text.tobytes()
    order = suffixes.suffix_array(text, depth)
    assert sorted(order.tolist()) == list(range(len(raw)))
    heads = [raw[i : i + depth] for i in order]
    assert heads == sorted(heads)
    lcp = suffixes.common_prefixes(text, order, depth)
    for k, n in enumerate(lcp):
        a, b = raw[order[k] :], raw[order[k + 1] :]
        assert a[:n] == b[:n] and (n == depth or a[n : n + 1] != b[n : n + 1] or not a[n : n + 1])


def brute_spans(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), len(dedup_spans.runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [3, 384])
def test_spans_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dedup_spans, "PIECES", block)
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, long = say(450), say(900)
    docs = [say(rng.randrange(900)) for _ in range(30)]
    docs += [say(rng.randrange(300)) + shared + say(rng.randrange(300)) for _ in range(25)]
    docs += [say(200) + long[rng.randrange(300) : rng.randrange(500, 900)] + say(100) for _ in range(25)]
    docs += [docs[0], docs[40], docs[40], long + say(50) + long, "x" * 1500, "ab" * 700, None, "", "short"]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(docs)] + [(4, docs[4]), (4, docs[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS spans", "3 AS raw").repartition(3)
    got = dedup_spans.remove_repeats(df).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_spans([t for _, t in rows], 400)


@pytest.mark.parametrize("block", [3, 384])
def test_documents_that_share_a_passage(spark, monkeypatch, block):
    monkeypatch.setattr(dedup_spans, "PIECES", block)
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    long = [say(700) for _ in range(3)]
    docs = [say(rng.randrange(600)) for _ in range(20)]
    for _ in range(40):
        a, k = rng.randrange(200), rng.randrange(150, 420)
        docs.append(say(rng.randrange(250)) + rng.choice(long)[a : a + k] + say(rng.randrange(250)))
    own = say(330)
    docs += [own + say(20) + own, docs[3], "x" * 900, None, ""]
    rows = [*enumerate(docs), (4, docs[4]), (4, docs[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dedup_spans.remove_repeats(df, passage=280).collect()
    holders = defaultdict(set)
    for r in set(rows):
        raw = (r[1] or "").encode()
        for i in range(len(raw) - 279):
            holders[raw[i : i + 280]].add(r)
    want = {d: 0 for d, _ in rows} | {d: 1 for who in holders.values() if len(who) > 1 for d, _ in who}
    assert 10 < sum(want.values()) < 60 and {r["doc_id"]: r["shared"] for r in got} == want
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_spans([t for _, t in rows], 400)


def test_spans_of_nothing_and_valid_text(spark):
    assert dedup_spans.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "é" * 400
    docs = spark.createDataFrame([(1, "a" + long + "b"), (2, "xyz" + long), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in dedup_spans.without_repeats(docs).collect()} == {1: "ab", 2: "xyz", 3: None}


# --- benchmark passages -----------------------------------------------------------------------------------------------


def edited(text, edits, rng):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice((text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "z" + text[i + 1 :]))
    return text


def least_edits(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_match_brute_force(spark):
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n)).strip()
    items = [(i, say(n)) for i, n in enumerate((30, 60, 99, 100, 101, 180, 330))] + [(90, "tiny"), (91, None), (None, say(70))]
    docs = []
    for _, t in items:
        for e in (0, 2, 5, 9, 14) if t else ():
            docs.append(say(60) + " " + edited(t, e, rng).upper().replace(" ", " \n") + " " + say(60))
    docs += [say(500), None, "", items[5][1][:110], say(9) + items[3][1]]
    rows = list(enumerate(docs)) + [(0, docs[0]), (None, docs[0])]
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    flat = lambda t: " ".join((t or "").lower().split())
    want = Counter()
    for d, t in rows:
        for i, item in items:
            s = flat(item)
            if len(s) < decontamination.SHORTEST:
                continue
            last = max(0, len(s) - 100)
            for a in sorted({*range(0, last, 50), last}):
                p = s[a : a + 100]
                if least_edits(p, flat(t)) <= max(0, min(len(p) // 10, (len(p) - 11) // 8)):
                    want[d, i] += 1
                    break
    assert got == want and len(want) > 20


def test_passages_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "text")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_passages(docs, items).count() == 0
    assert decontamination.without_passages(docs, items).count() == 1
    assert decontamination.find_passages(docs.limit(0), spark.createDataFrame([(1, "x" * 50)], "item_id long, text string")).count() == 0


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    whole = sorted(map(tuple, decontamination.op9_benchmark_passages(spark, SF).collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 1500)
    assert sorted(map(tuple, decontamination.op9_benchmark_passages(spark, SF).collect())) == whole and whole


# --- vectors --------------------------------------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            base = rng.normal(size=48)
            for _ in range(rng.integers(1, 7)):
                rows.append((n, (base + rng.normal(size=48) * 0.09).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, rows[0][1], None), (n + 4, None, 0), (n + 5, [0.0] * 48, 0), (n + 6, [float("nan")] * 48, 0), (n + 7, [None] + [1.0] * 47, 0), (n + 8, [1.0, 2.0], 0), (n + 9, [2.0, 4.0], 0), (n + 10, [], 0)]
    got = {r["vec_id"]: r for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS fine")).collect()}
    assert len(got) == len(rows)
    links = []
    for i, (a, x, la) in enumerate(rows):
        for b, y, lb in rows[:i]:
            if la is None or la != lb or not x or not y or len(x) != len(y) or None in x or None in y:
                continue
            x1, y1 = np.array(x), np.array(y)
            if np.isfinite(x1).all() and np.isfinite(y1).all() and x1.any() and y1.any() and x1 @ y1 >= 0.98 * np.linalg.norm(x1) * np.linalg.norm(y1):
                links.append((a, b))
    count = Counter(x for p in links for x in p)
    found = sum(r["n_links"] for r in got.values()) / 2
    assert all(r["n_links"] <= count[v] for v, r in got.items())
    assert found >= 0.9 * len(links) and len(links) > 100
    assert got[n + 9]["component_id"] == n + 8 and got[n + 3]["n_links"] == got[n + 4]["n_links"] == got[n + 6]["n_links"] == 0
    assert all(r["kept"] == (v == r["component_id"]) for v, r in got.items())
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    all_ = sum(int(((x[label == k] @ x[label == k].T) >= 0.98).sum() - (label == k).sum()) for k in set(label))
    got = sum(r["n_links"] for r in vectors.op5_near_vectors(spark, sf).collect())
    assert 0.9 * all_ <= got <= all_


# --- pages ------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header><a href="/">Site name</a></header><nav><ul><li><a href=1>Home<li><a href=2>News</ul></nav>
<div class="cookie-notice"><p>We use cookies on this page to make it work better for you all.</p></div>
<article><header class="entry-header"><h1>A &lt;title&gt; &eacute;</h1></header><p>First   paragraph,
with <a href="x">a link</a> &amp; more.<br>Next line.<p>Second one.</p><ul><li>point<li>other point</ul>
<div class="share-buttons"><a>Tweet</a></div><aside>See also that.</aside><script>var x = "<p>no</p>";</script></article>
<section id="comments"><p>I am a reader and this is my comment on all of it.</p></section>
<form><label>Search</label><input></form><footer>&copy; all rights</footer></body>"""


def test_article_text():
    tree = pages.train()
    assert pages.main_text(PAGE, tree) == "A <title> é\n\nFirst paragraph, with a link & more. Next line.\n\nSecond one.\n\npoint\n\nother point"
    plain = '<body><div id=menu><a href=1>a</a> <a href=2>b</a></div><div><h2>Head of it</h2><p>' + "Long running text of a page without an article. " * 4 + "</p><p>Short end.</p></div><div class=footer>legal words</div>"
    assert pages.main_text(plain, tree).split("\n\n")[0] == "Head of it" and pages.main_text(plain, tree).endswith("Short end.")
    assert [pages.main_text(x, tree) for x in (None, "", "<", "<p", "<article>", "<!-- x")] == [""] * 6
    assert pages.main_text("<article><p>" + "<b>deep " * 3000 + "end", tree).endswith("end")


def test_tree_learns_from_its_table():
    table = pages.labelled()
    assert len(table) > 200 and 0.3 < table[:, -1].mean() < 0.7
    assert (pages.train().predict(table[:, :-1]) == table[:, -1]).mean() > 0.97


def test_pages_query(spark):
    rows = pages.op4_main_text(spark, SF).collect()
    assert len(rows) == 50 and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    odd = spark.createDataFrame([(1, "u", None), (None, None, PAGE), (1, "u", PAGE)], "page_id long, url string, html string")
    assert sorted(len(r["text"]) > 0 for r in pages.extract_text(odd).collect()) == [False, True, True]


# --- context trees -----------------------------------------------------------------------------------------------------------


def brute_tree(train, test, depth):
    count, kids = defaultdict(lambda: [0, 0]), defaultdict(set)

    def symbols(t):
        b = [*t, 255]
        return [(b[i], tuple(b[i - k] if i >= k else 255 for k in range(1, depth + 1))) for i in range(len(b))]

    for t in train:
        for s, c in symbols(t):
            for j in range(8):
                p, bit = (1 << j) | (s >> (8 - j)), (s >> (7 - j)) & 1
                for d in range(depth + 1):
                    count[c[:d], p][bit] += 1
                    if d < depth:
                        kids[c[:d], p].add((c[: d + 1], p))
    own = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n[0] + n[1] + 1)
    memo = {}

    def weighted(node):
        if node not in memo:
            o = own(count.get(node, [0, 0]))
            if len(node[0]) < depth:
                b = sum(weighted(k) for k in kids.get(node, ()))
                m = max(o, b)
                o = m + math.log(0.5 * math.exp(o - m) + 0.5 * math.exp(b - m))
            memo[node] = o
        return memo[node]

    def predict(d, c, p, bit):
        n = count.get((c[:d], p), [0, 0])
        here = (n[bit] + 0.5) / (n[0] + n[1] + 1)
        if d == depth:
            return here
        share = 0.5 * math.exp(own(n) - weighted((c[:d], p)))
        return share * here + (1 - share) * predict(d + 1, c, p, bit)

    return [sum(math.log10(predict(0, c, (1 << j) | (s >> (8 - j)), (s >> (7 - j)) & 1)) for s, c in symbols(t) for j in range(8)) for t in test]


@pytest.mark.parametrize("hot", [4, 1 << 12])
def test_tree_scores_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ctw, "HOT_GRAMS", hot)
    monkeypatch.setattr(ctw, "HOT_WORDS", hot)
    texts = ["Abra cadabra", "abra abra cad", "the cat sat", "zebra", "", "été là", "the cat the cat", "\tthe\x0bcat\n"] + [f"word{i % 3} the cat" for i in range(12)]
    rows = [*enumerate(texts), (3, "zebra"), (50, None), (None, "the cat")]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS item")
    got = ctw.score_texts(docs.withColumn("held_out", ctw.F.coalesce(ctw.fold("doc_id", 10) == 0, ctw.F.lit(True)))).collect()
    low = lambda t: (t or "").encode().lower()
    want = dict(zip(rows, brute_tree([low(t) for i, t in rows if not held(i)], [low(t) for _, t in rows], ctw.DEPTH)))
    words = Counter(w for i, t in rows if not held(i) for w in [*low(t).split(), None])
    n, v = sum(words.values()), len(words)
    assert len(got) == len(rows)
    by_id = {i: (i, t) for i, t in rows}
    for r in got:
        t = low(by_id[r["doc_id"]][1])
        tokens = [*t.split(), None]
        assert r["score"] == pytest.approx(want[by_id[r["doc_id"]]], rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(words[w] > 0 for w in tokens), n, held(r["doc_id"]))


def test_tree_without_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert ctw.score_texts(empty).count() == 0
    only = spark.createDataFrame([(1, "abc", True)], "doc_id long, text string, held_out boolean")
    r = ctw.score_texts(only).first()
    assert r["score"] == pytest.approx(4 * 8 * math.log10(0.5)) and r["train_tokens"] == 0 and r["n_known"] == 0


# --- mixing -------------------------------------------------------------------------------------------------------------------


def test_targets_are_filled_by_weight(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "b", "c", "d", "big", "big", "big", None])) for i in range(4000)] + [(None, "x y", "a"), (1, None, "z"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target")
    got = mixing.mix_sources(docs).collect()
    size, target, taken = {}, {}, Counter()
    for r in got:
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(size.values()), set(order), {}
    while True:  # share, stop at the caps, share the excess again
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] >= 2 * size[s]}
        if not full:
            want |= part
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
        open_ -= full
        if not open_:
            break
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.15 * target[s] + 1
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.emit_copies(mixing.mix_sources(docs)).count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
