"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, and a rerank by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import read, stage, tidy, unstage
from modlens.llm.graph import components

BITS, TABLES = 64, 4
SUB = BITS // TABLES
DENSE, SALTS = 4, 32  # classes that make a pivot: as few as, as many as
SLACK = 1e-6  # radians between the bounds of cliques and the angle itself


class Quantiser:
    """Binary codes: the signs of the principal components after a rotation that brings them near the corners of a cube."""

    def fit(self, x: np.ndarray, rounds: int = 40, seed: int = 5) -> Quantiser:
        rng = np.random.default_rng(seed)
        bits = min(BITS, x.shape[1])
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        _, vectors = np.linalg.eigh(np.cov(x - self.mean, rowvar=False).reshape(x.shape[1], -1) if len(x) > 1 else np.eye(x.shape[1]))
        top = vectors[:, ::-1][:, :bits]
        v = (x - self.mean) @ top
        turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        self.project = top @ turn
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        on = ((x - self.mean) @ self.project) >= 0
        return (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def unit(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length as unit vectors in double precision."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_vectors(vectors: DataFrame, least: float = 0.98, most_bits: int = 16, sample: int = 4_000) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and their cosine, in double precision, is `least` or more.
    Vectors that are null or zero, or hold null or non-finite components, link with nothing; nor do vectors of unequal
    length, and long ones only cost more. n_links counts rows, also those of the same vector; component_id is the smallest
    vec_id that links reach, so ties of cosine or repeated rows and ids change nothing. A null vec_id never is a
    component_id. An empty table gives no rows; other columns are ignored, whatever their names.

    Rows of equal label and vector form one class, so copies meet neither tables nor rerank. Classes within half of the
    link's angle of a common pivot form a clique, whose members are all linked by the inequality of the triangle. Every
    class is indexed in TABLES tables by a quarter of its code, and looked up there with each single bit of the quarter
    turned too: codes that differ in less than 2 * TABLES bits always meet, others mostly. What meets are cliques, and
    classes of none; classes meet only with up to most_bits different bits. Pivots and radii decide most pairs of cliques
    as a whole; of the others all members are compared. The rotation is learned from about `sample` classes, taken by a
    hash, of each vector length.
    """
    spark = vectors.sparkSession
    size = F.size("embedding")
    real = F.col("label").isNotNull() & (size > 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    fine = F.coalesce(real, F.lit(False))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("fine", fine)
    # an exact class: grouping is by label and vector, its node 128 bits of hash of both
    node = F.concat_ws("-", F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64(F.lit("again"), "embedding", "label")))
    rows = rows.withColumn("node", F.when(F.col("fine"), node))
    classes = stage(rows.where("fine").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")), "vec-classes")
    codes = stage(coded(classes, sample), "vec-codes")
    members, cliques = in_cliques(classes, codes, least)
    of = members.select(F.col("node").alias("at"), "unit")
    joined = codes.join(of, F.col("node") == F.col("at"), "left")
    # a class of no clique is a unit of its own; only its code says how near it can be
    units = joined.select("node", F.coalesce("unit", "node").alias("unit"), F.when(F.col("unit").isNull(), F.col("code")).alias("own"), "code", "label", "dim")
    alone = classes.join(of, F.col("node") == F.col("at"), "left_anti").select(F.col("node").alias("unit"), F.col("embedding").alias("pivot"), F.lit(0.0).alias("radius"), F.col("n").alias("total"))
    heads = stage(alone.unionByName(cliques), "vec-units")

    each = units.withColumn("t", F.explode(F.array(*[F.lit(t) for t in range(TABLES)]))).select("unit", "own", "label", "dim", "t", _shift("code", "t").alias("part")).distinct()
    each = stage(each, "vec-index")
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(SUB)]).cast("array<long>")
    index = each.select(F.col("unit").alias("b"), F.col("own").alias("cb"), F.col("label").alias("lb"), F.col("dim").alias("db"), F.col("t").alias("tb"), F.col("part").alias("pb"))
    probes = each.withColumn("flip", F.explode(flips)).withColumn("probe", F.col("part").bitwiseXOR(F.col("flip")))
    meet = (F.col("label") == F.col("lb")) & (F.col("dim") == F.col("db")) & (F.col("t") == F.col("tb")) & (F.col("probe") == F.col("pb")) & (F.col("unit") < F.col("b"))
    near = F.coalesce(F.bit_count(F.col("own").bitwiseXOR(F.col("cb"))) <= most_bits, F.lit(True))
    pairs = stage(probes.join(index, meet & near).select(F.col("unit").alias("a"), "b").distinct(), "vec-pairs")

    angle = float(np.arccos(np.clip(least, -1, 1)))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Linked pairs of units, and with open = true those that have to be looked at member by member."""
        for b in batches:
            cos, exact = cosines(b.column("x"), b.column("y"), least)
            reach = np.asarray(b.column("ra")) + np.asarray(b.column("rb"))
            away = np.arccos(np.clip(cos, -1, 1))
            single = reach == 0
            whole = np.where(single, exact, away + reach <= angle - SLACK)
            open_ = ~single & ~whole & (away - reach <= angle + SLACK)
            keep = pa.array(whole | open_)
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(keep) for c in ("a", "b", "na", "nb")), pa.array(open_).filter(keep)], names=["a", "b", "na", "nb", "open"])

    xs = heads.select(F.col("unit").alias("a"), F.col("pivot").alias("x"), F.col("total").alias("na"), F.col("radius").alias("ra"))
    ys = heads.select(F.col("unit").alias("b"), F.col("pivot").alias("y"), F.col("total").alias("nb"), F.col("radius").alias("rb"))
    both = pairs.join(xs, "a").join(ys, "b").select("a", "b", "na", "nb", "x", "y", "ra", "rb")
    links = stage(both.mapInArrow(tidy(decided), "a string, b string, na long, nb long, open boolean"), "vec-links")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, exact = cosines(b.column("x"), b.column("y"), least)
            yield b.select(["a", "b", "node", "other", "na", "nb"]).filter(pa.array(exact))

    full = units.select("node", "unit").join(classes.select(F.col("node").alias("at"), "embedding", "n"), F.col("node") == F.col("at"))
    left = full.select(F.col("unit").alias("a"), "node", F.col("embedding").alias("x"), F.col("n").alias("na"))
    right = full.select(F.col("unit").alias("b"), F.col("node").alias("other"), F.col("embedding").alias("y"), F.col("n").alias("nb"))
    single = links.where("open").select("a", "b").join(left, "a").join(right, "b").select("a", "b", "node", "other", "na", "nb", "x", "y")
    single = stage(single.mapInArrow(tidy(confirmed), "a string, b string, node string, other string, na long, nb long"), "vec-singles")

    whole = links.where("NOT open")
    roots = components(whole.select("a", "b").union(single.select("a", "b").distinct())).select(F.col("node").alias("at"), "root")
    sums = lambda df, of, n, name: df.groupBy(F.col(of).alias(f"{name}_of")).agg(F.sum(n).alias(name))
    by_unit = sums(whole.select(F.col("a").alias("of"), F.col("nb").alias("n")).union(whole.select("b", "na")), "of", "n", "others")
    by_node = sums(single.select(F.col("node").alias("of"), F.col("nb").alias("n")).union(single.select("other", "na")), "of", "n", "more")
    info = units.select("node", "unit").join(heads.select(F.col("unit").alias("u"), "total"), F.col("unit") == F.col("u"))
    info = info.join(by_unit, F.col("unit") == F.col("others_of"), "left").join(by_node, F.col("node") == F.col("more_of"), "left").join(roots, F.col("unit") == F.col("at"), "left")
    n_links = F.col("total") - 1 + F.coalesce("others", F.lit(0)) + F.coalesce("more", F.lit(0))
    info = stage(info.select("node", n_links.alias("n_links"), F.coalesce("root", "unit").alias("root")), "vec-info")
    firsts = rows.where("fine").groupBy(F.col("node").alias("of")).agg(F.min("vec_id").alias("least"))
    firsts = firsts.join(info.select("node", "root"), F.col("of") == F.col("node")).groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    info = info.join(firsts, F.col("root") == F.col("r")).select(F.col("node").alias("of"), "n_links", "component_id")
    unstage(codes, members, cliques, heads, each, pairs, links, single, classes)
    # rows without a node get one of their own that nothing has, so that nulls don't meet in one task
    out = rows.select("vec_id", "fine", F.coalesce("node", F.concat(F.lit("none"), F.xxhash64("vec_id").cast("string"))).alias("node"))
    out = out.join(info, (F.col("node") == F.col("of")) & F.col("fine"), "left")
    component = F.when(F.col("of").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def coded(classes: DataFrame, sample: int) -> DataFrame:
    """node, label, dim, code of each class."""
    models = {}
    for dim, n in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("node").alias("n")).collect()):
        part = F.pmod(F.xxhash64(F.lit("itq"), F.col("node")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        got = classes.where((F.col("dim") == dim) & (part < min(1.0, sample / n))).select("node", "embedding").toArrow().sort_by("node")
        models[dim] = Quantiser().fit(unit(got.column("embedding").combine_chunks()) if len(got) else np.eye(dim))
    sent = classes.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            code = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                code[at] = sent.value[int(d)].codes(unit(b.column("embedding").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), b.column("dim"), pa.array(code)], names=["node", "label", "dim", "code"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("node", "label", "dim", "embedding").mapInArrow(tidy(run), f"node string, label {label}, dim int, code long")


def in_cliques(classes: DataFrame, codes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, unit) of the classes in cliques, and (unit, pivot, radius, total) of the cliques.

    Where half a code is common to DENSE classes, the mean of up to SALTS of them is a pivot. A class joins the nearest
    pivot of its halves, if that is near enough. Buckets are summed up by salts before they meet, so a hot one sends few
    rows; which vectors make a pivot changes what is compared, but not what is linked.
    """
    halves = F.posexplode(F.array(F.shiftrightunsigned("code", 32), F.col("code").bitwiseAND(F.lit((1 << 32) - 1))))
    keys = ["label", "dim", "half", "bits"]
    rows = codes.select("node", "label", "dim", halves.alias("half", "bits"))
    dense = rows.groupBy(*keys).agg(F.count("node").alias("k")).where(F.col("k") >= DENSE).drop("k")
    rows = stage(rows.join(dense, keys).join(classes.select("node", "embedding", "n"), "node"), "vec-dense")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).groupBy(*keys, "salt").agg(F.min_by("embedding", "node").alias("e"))
    length = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, v: s + v * v))
    salted = salted.withColumn("e", F.transform("e", lambda v: v / length(F.col("e"))))
    mean = F.aggregate(F.array_sort(F.collect_list("e")), F.array_repeat(F.lit(0.0), F.max("dim")), lambda s, e: F.zip_with(s, e, lambda a, b: a + b))
    pivots = stage(salted.groupBy(*keys).agg(mean.alias("pivot")), "vec-pivots")
    most = float(np.arccos(np.clip(least, -1, 1))) / 2 - SLACK

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = np.arccos(np.clip(cosines(b.column("embedding"), b.column("pivot"), least)[0], -1, 1))
            b = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "n", *keys)), pa.array(away)], names=["node", "n", *keys, "away"])
            yield b.filter(pa.array(away <= most))

    label = classes.schema["label"].dataType.simpleString()
    schema = f"node string, n long, label {label}, dim int, half int, bits long, away double"
    close = rows.join(pivots, keys).select("node", "n", *keys, "embedding", "pivot").mapInArrow(tidy(measured), schema)
    taken = stage(close.groupBy("node").agg(F.min(F.struct("away", "half", "bits", "label", "dim", "n")).alias("x")).select("node", "x.*"), "vec-taken")
    cliques = taken.groupBy(*keys).agg(F.min("node").alias("unit"), F.max("away").alias("radius"), F.sum("n").alias("total"), F.count("node").alias("k")).where("k > 1")
    cliques = stage(cliques.join(pivots, keys).select(*keys, "unit", "pivot", F.greatest("radius", F.lit(SLACK)).alias("radius"), "total"), "vec-cliques")
    members = stage(taken.join(cliques.select(*keys, "unit"), keys).select("node", "unit"), "vec-members")
    unstage(rows, pivots, taken)
    found = cliques.select("unit", "pivot", "radius", "total")
    found.staged_at = cliques.staged_at
    return members, found


def cosines(x: pa.Array, y: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each row of x with that of y, of equal length, and whether it is `least` or more."""
    n = np.asarray(x.value_lengths())
    x, y = np.asarray(x.flatten(), np.float64), np.asarray(y.flatten(), np.float64)
    at = np.cumsum(n) - n  # a batch may hold several lengths
    dot = lambda p, q: np.add.reduceat(p * q, at) if len(at) else np.zeros(0)
    xy, xx, yy = dot(x, y), dot(x, x), dot(y, y)
    with np.errstate(invalid="ignore", divide="ignore"):
        return xy / (np.sqrt(xx) * np.sqrt(yy)), xy >= least * np.sqrt(xx) * np.sqrt(yy)


def _shift(code: str, table: str):
    """The table's quarter of the code."""
    out = F.lit(0).cast("long")
    for t in range(TABLES):
        out = F.when(F.col(table) == t, F.shiftrightunsigned(code, SUB * t).bitwiseAND(F.lit((1 << SUB) - 1))).otherwise(out)
    return out


def op5_near_vectors(spark, sf_dir):
    return link_vectors(read(spark, sf_dir, "embeddings"))
