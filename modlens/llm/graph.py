"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import stage, unstage

JUMPS = 2  # doublings of the pointers in a round: paths get shorter by a factor of 4 at the least


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """node, root of every node of links (a, b): root is the smallest node that links reach.

    Contraction: each node points at its smallest neighbour, or itself if that is smaller; pointers are followed a few
    steps; both ends of the links are renamed to where their pointers lead, and links that still join two nodes go round
    again. Renaming both ends keeps what is connected connected, however far a pointer was followed, and the smallest
    node of a component always points at itself, so it is the name that stays. Every round is two tables in the shared
    folder, and the renamings are put together at the end. Pointers are followed twice as far in each later round, so
    even a path in the order of its nodes takes rounds of the root of the logarithm only.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    first, maps, dropped = edges, [], []
    for i in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        hook = both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root"))
        for j in range(JUMPS + i):
            if j >= JUMPS:  # long paths only; a table keeps the plan small
                dropped.append(hook := stage(hook, "hooks"))
            up = hook.select(F.col("node").alias("at"), F.col("root").alias("next"))
            hook = hook.join(up, F.col("root") == F.col("at")).select("node", F.col("next").alias("root"))
        maps.append(hook := stage(hook, "hooks"))
        h = hook.select(F.col("node").alias("old"), F.col("root").alias("new"))
        left = edges.join(h, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b").join(h, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        left = stage(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if edges is not first:
            dropped.append(edges)
        edges = left
    else:
        raise RuntimeError(f"links are left after {rounds} rounds")
    names = first.select(F.col("a").alias("node")).union(first.select("b")).distinct().select("node", F.col("node").alias("root"))
    for hook in maps:
        h = hook.select(F.col("node").alias("old"), F.col("root").alias("new"))
        names = names.join(h, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    names = stage(names, "roots")
    unstage(first, edges, *maps, *dropped)
    return names
