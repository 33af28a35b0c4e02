"""The trie of conversations' prefixes: which conversations share their first turns, and what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.llm.common import WORD, read, small_batches, stage, tidy, unstage

#: Conversations whose heads are taken from the first of them, and how many turns that are at the most.
GROUP, HEAD = 20, 3
#: Ids of a piece of a node's list.
PIECE = 4096
NODE = ("depth", "k1", "k2")


def _earlier(*order: str):
    return Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, digest, words of each turn, written in order: `at` rises by one from row to row within a partition's part of
    the table, and at >> 33 tells the part. A long conversation lies in several parts. Texts end here: the digest is the
    SHA-256 of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = stage(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words")), "trie-turns")
    order = F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = stage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), "digest", "words"), "trie-sorted")
    unstage(rows)
    return out


def rebuilt_turns(turns: DataFrame, group: int = GROUP, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conv_id, block, depth, last_depth, digest, words) of the rebuilt conversations' turns, and (conv_id, last_depth) of all of them.

    A conversation c begins with the first h turns of conversation c - c % group, h = crc32(c) % (head + 1), and goes on
    with its own turns after its first h. Depths come from the number of rows of each block, a conversation's rows in
    one part of the sorted table, so no task sees a long conversation whole.
    """
    block = F.shiftright("at", 33)
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    convs = blocks.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base, own_h = F.expr(f"conv_id - conv_id % {group}"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head + 1))
    convs = convs.select("conv_id", "n", base.alias("base"), F.when(base == F.col("conv_id"), 0).otherwise(own_h).alias("skip"))
    lengths = convs.select(F.col("conv_id").alias("of"), F.col("n").alias("base_n"))
    heads = F.least("skip", _zero(F.col("base_n")))
    convs = convs.join(lengths, F.col("base") == F.col("of"), "left").select("conv_id", "base", "skip", heads.alias("heads"), (heads + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("last_depth"))
    convs = stage(convs, "trie-convs")
    places = blocks.select("conv_id", "block", "first", _zero(F.sum("n").over(_earlier("block"))).alias("before")).join(convs.drop("base"), "conv_id")
    rows = turns.withColumn("block", block).join(places, ["conv_id", "block"]).withColumn("rank", F.expr("before + at - first"))
    own = rows.where("rank >= skip").select("conv_id", "block", F.expr("heads + rank - skip + 1").alias("depth"), "last_depth", "digest", "words")
    first = rows.where(f"rank < {head} AND conv_id % {group} = 0").select(F.col("conv_id").alias("of"), "rank", "digest", "words")
    taken = convs.where("heads > 0").join(first, (F.col("base") == F.col("of")) & (F.col("rank") < F.col("heads")))
    taken = taken.select("conv_id", F.lit(-1).cast("long").alias("block"), F.expr("rank + 1").alias("depth"), "last_depth", "digest", "words")
    return own.unionByName(taken), convs.select("conv_id", "last_depth")


def occurrences(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and each of its prefixes, the empty one included: conv_id, node (depth, k1, k2), parent (p1, p2),
    words of the last turn, words before it, whether the conversation ends there.

    A prefix's key is the exclusive or of 128-bit hashes of (depth, digest) of its turns: running sums within a block, joined
    with the sums of the blocks before it.
    """
    hashes = {f"x{i}": F.xxhash64(F.lit(i), F.col("depth").cast("long"), "digest") for i in (1, 2)}
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rebuilt.withColumns(hashes).select("conv_id", "block", "depth", "last_depth", "words", "x1", "x2", *[F.bit_xor(x).over(so_far).alias(k) for x, k in (("x1", "k1"), ("x2", "k2"))], F.sum("words").over(so_far).alias("through"))
    rows = stage(rows, "trie-local")
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("words").alias("bw"))
    sums = sums.select("conv_id", "block", *[_zero(f(c).over(_earlier("block"))).alias(c) for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bw"))])
    k1, k2 = F.col("k1").bitwiseXOR(F.col("b1")), F.col("k2").bitwiseXOR(F.col("b2"))
    rows = rows.join(sums, ["conv_id", "block"]).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"),
        "words", F.expr("bw + through - words").alias("before"), F.expr("int(depth = last_depth)").alias("ends"),
    )
    roots = convs.selectExpr("conv_id", "0L AS depth", "0L AS k1", "0L AS k2", "CAST(NULL AS long) AS p1", "CAST(NULL AS long) AS p2", "0L AS words", "0L AS before", "int(last_depth = 0) AS ends")
    return stage(rows.unionByName(roots), "trie-occurrences")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) in order as rows (node, first, ids): up to PIECE ids of a node joined by commas."""
    names = [*NODE, "first", "ids"]
    node, ids = None, []

    def made(rows: list) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        out = []
        for *at, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != node or len(ids) == PIECE:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = at, []
            ids.append(i)
        if out:
            yield made(out)
    if ids:
        yield made([(*node, ids[0], ",".join(map(str, ids)))])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as rows (node, hash): the SHA-256 of all ids of a node, fed piece by piece."""
    node, so_far = None, None
    for b in batches:
        out = []
        for *at, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at == node:
                so_far.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, so_far.hexdigest()))
            node, so_far = at, hashlib.sha256(ids.encode())
        if out:
            yield _hashed(out)
    if node:
        yield _hashed([(*node, so_far.hexdigest())])


def _hashed(rows: list) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*NODE, "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 from rows (depth, k1, k2, conv_id): ids ascending, joined by commas. A node's ids are joined in many
    tasks, in pieces of PIECE ids, and one task hashes the pieces as they come; it holds one of them."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*NODE, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(_pieces), "depth long, k1 long, k2 long, first long, ids string")
    # a piece may end at a partition's border, but pieces of a node never overlap
    return pieces.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(tidy(_hashes), "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """A row for each distinct sequence of first turns (role, text) of the rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is owned by its smallest member, so each conversation owns the end of its own path, from some depth on. What a
    subtree saves is the words its members say from there on without the words they own there: for one member, the words
    between the node and where its own part begins. One group-by over prefixes adds that up, with a flag for members whose
    path ends in a childless node of their own. Prefixes that many conversations share are summed up before they are
    shuffled; no join has more than one row for a key on its right side.

    Turns are in the order of turn, null first, then of a hash of role and text; null role or text is empty. Rows
    without conv_id belong to no conversation and are left out; repeated turns are turns. A conversation whose rebuilt form
    has no turn is a member of the root. An empty table gives no rows. Other columns are ignored. Texts are read whole, once.
    """
    small_batches(conversations.sparkSession)
    turns = sorted_turns(conversations)
    seen = occurrences(*rebuilt_turns(turns, group, head))
    nodes = seen.groupBy(*NODE, "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("n_ends"), F.max("words").alias("words"), F.max("before").alias("before"))
    nodes = stage(nodes, "trie-nodes")
    unstage(turns)
    owned = nodes.groupBy("conv_id").agg(F.min("before").alias("own_from"), F.max(F.expr("int(n_convs = n_ends)")).alias("leaf"))
    paths = seen.where("ends = 1").select("conv_id", F.expr("before + words").alias("whole")).join(owned, "conv_id", "left")
    paths = paths.select("conv_id", F.coalesce("own_from", "whole").alias("own_from"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = seen.join(paths, "conv_id").groupBy(*NODE).agg(F.sum(F.greatest(F.col("own_from") - F.col("before"), F.lit(0).cast("long"))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, list(NODE)).join(children, list(NODE), "left").join(ends_hashes(seen.where("ends = 1")), list(NODE), "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", _zero(F.col("n_children")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(read(spark, sf_dir, "conversations"))


SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295::BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, r, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.r <= c.h
  UNION ALL SELECT c.conv_id, r, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.r > c.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY conv_id) AS last
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY r)
  UNION ALL SELECT conv_id, 0, '', 0, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
  FROM paths GROUP BY path, depth
), shaped AS (
  SELECT v.*, (SELECT count(*) FROM nodes u WHERE u.depth = v.depth + 1 AND starts_with(u.path, v.path)) AS n_children FROM nodes v
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
  (SELECT count(*) FROM shaped u WHERE starts_with(u.path, v.path) AND u.n_children = 0) AS n_leaves,
  (SELECT sum((u.n_convs - 1) * u.words) FROM shaped u WHERE starts_with(u.path, v.path))::BIGINT AS saved_tokens, v.ends_sha256
FROM shaped v LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = substr(v.path, 1, 32 * (v.depth - 1))
"""
