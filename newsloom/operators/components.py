"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.staging import stage, unstage

MAX_ROUNDS = 60
#: Edge tables up to this size, which is counted, are settled by one task in one step.
SMALL = 15_000


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """u, v with u > v for every node that is not its component's smallest, which is v."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch["u"].tolist(), batch["v"].tolist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    hung = [(x, find(x)) for x in list(root) if find(x) != x]
    yield pd.DataFrame({"u": [x for x, _ in hung], "v": [y for _, y in hung]}, dtype="int64")


def _roots_hang(hung: DataFrame) -> DataFrame:
    return hung.select(F.col("v").alias("w")).join(hung.select("u"), F.col("w") == F.col("u"), "left_semi")


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", small: int = SMALL) -> DataFrame:
    """(node, component) for each node of edges (integers); component is its smallest node.

    Up to `small` edges are settled in one step. Beyond that two steps that hang nodes under smaller neighbours alternate
    until every node hangs directly under its root, which takes about log(size) rounds whatever the graph's shape. Each
    round's edges are staged and the round before is deleted; a hot node's edges meet in plain joins of staged tables,
    which adaptive execution splits. Both ways give the same rows. Nulls and loops link nothing.
    """
    hung = edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v")).where("u > v").distinct()
    hung = stage(hung, "edges")
    if hung.count() <= small:
        return _named(hung.coalesce(1).mapInPandas(_settle, "u long, v long"))
    for _ in range(MAX_ROUNDS):
        both = hung.union(hung.select("v", "u"))
        nearest = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w"), "lowest")
        wide = hung.select(F.col("v").alias("x"), "u").join(nearest, F.col("x") == F.col("w")).select("u", F.col("m").alias("v"))
        own = nearest.where("m < w").select(F.col("w").alias("u"), F.col("m").alias("v"))
        flat = stage(wide.union(own).where("u > v").distinct(), "edges")
        lowest = stage(flat.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "lowest")
        side = flat.join(lowest, F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        later = stage(side.union(lowest.select("w", "m")).distinct(), "edges")
        settled = later.count() == lowest.count() and _roots_hang(later).isEmpty()
        unstage(hung, nearest, flat, lowest)
        hung = later
        if settled:
            return _named(hung)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _named(hung: DataFrame) -> DataFrame:
    roots = hung.groupBy("v").agg(F.first("v").alias("component")).select(F.col("v").alias("node"), "component")
    return hung.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
