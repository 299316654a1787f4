"""Cosines, nearest neighbours and time-ordered candidate links of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.plans.staging import in_blocks, stage


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for vectors that are null, zero or of different lengths."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    rows = np.array(column.flatten(), np.float64).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def nearest(queries: DataFrame, base: DataFrame, k: int, block_rows: int = 4000, exclude_same: str | None = None, keep_own: bool = False) -> DataFrame:
    """(q, id, score, place): for each query (q, qv) the k rows of base (id, v) of highest cosine, ties to the lower id.

    With exclude_same, a column of both sides, rows with the query's own value are left out before the best k are taken,
    so each query gets k rows if there are as many; rows in which it is null neither ask nor are found.

    Both sides are dealt into blocks, whose numbers follow from their counts; each block of queries meets each block of
    base in a task of its own, where one matrix product gives every query its best k of the block, and the best of those
    are kept. No task holds more than two blocks. A query's own id is left out unless keep_own. Vectors share one length.
    """
    blocks, asking = (max(1, -(-df.count() // block_rows)) for df in (base, queries))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = F.col(exclude_same).cast("string") if exclude_same else F.lit("")
    dealt = base.select("id", "v", group.alias("own"), deal("id", blocks).alias("block"), every(asking).alias("asking")).where("own is not null")
    asked = queries.select("q", "qv", group.alias("own"), deal("q", asking).alias("asking"), every(blocks).alias("block")).where("own is not null")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        right = right.sort_by("id")
        qs, ids, unit, mine = np.array(left["q"]), np.array(right["id"]), _unit(right["v"]), _unit(left["qv"])
        groups = np.unique(np.concatenate([np.array(left["own"]), np.array(right["own"])]), return_inverse=True)[1]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(qs), 512):
            scores = mine[at : at + 512] @ unit.T
            if not keep_own:
                scores[qs[at : at + 512, None] == ids[None, :]] = -np.inf
            if exclude_same:
                scores[groups[at : min(at + 512, len(qs)), None] == groups[None, len(qs) :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(scores, top, 1)
            keep = np.isfinite(value)
            found.append((np.repeat(qs[at : at + 512], keep.sum(1)), ids[top[keep]], value[keep]))
        q, i, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    met = asked.groupBy("block", "asking").cogroup(dealt.groupBy("block", "asking")).applyInArrow(best, "q long, id long, score double")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def undirected_best(neighbours: DataFrame) -> DataFrame:
    """One edge a < b per pair of neighbour rows with its best score, rounded to four digits."""
    return neighbours.groupBy(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b")).agg(F.round(F.max("score"), 4).alias("score"))


#: Children whose cosines with a block of parents are taken at once, and rows of a topic and slot that meet in one task: at 64
#: single numbers each they are 8 MB. A larger slot is repeated once for each block that it has, so small blocks cost disk.
CHILDREN_AT_ONCE, BLOCK_ROWS = 64, 32_000


def earlier_candidates(vectors: DataFrame, max_lag_s: int, least: float, block_rows: int = BLOCK_ROWS, most: int | None = None) -> DataFrame:
    """(child, parent, score): pairs of one topic, the parent published within max_lag_s before the child, cosine >= least.

    vectors: (id, topic, published_s, v). Rows meet by topic and time slot of the lag's length (own slot and the one
    before), so a pair meets once and a topic's whole history never does; a slot of many rows meets in blocks, each of
    which takes its cosines as arrays, summed in the order of the entries. With most, a block returns no more than a
    child's so many best parents (ties to the lower id), so that each child's best of all blocks are among them.
    """
    rows = vectors.where("published_s is not null and topic is not null and size(v) > 0 and not exists(v, x -> x is null)")
    rows = rows.select("id", "topic", "published_s", F.size("v").alias("n"), F.floor(F.col("published_s") / max_lag_s).alias("slot"), "v")
    rows = rows.withColumn("vv", dot(F.col("v"), F.col("v")))  # in double precision; vectors travel as they are given
    child = rows.select(F.col("id").alias("child"), "topic", "n", F.col("published_s").alias("t"), F.col("v").alias("cv"), F.col("vv").alias("cc"), F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"))
    parent = rows.select(F.col("id").alias("parent"), "topic", "n", "slot", F.col("published_s").alias("u"), F.col("v").alias("pv"), F.col("vv").alias("pp"))
    children, parents, blocks = in_blocks(child, parent, ["topic", "slot", "n"], "child", "parent", block_rows)
    children, parents = (df.toDF(*df.columns) for df in (children, parents))  # columns of their own: both come from one table
    flat = lambda column, n: np.array(column.combine_chunks().flatten(), np.float64).reshape(n, -1)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        found = [none]
        if left.num_rows and right.num_rows:
            right = right.sort_by("parent")
            mine, theirs = flat(left["cv"], left.num_rows), np.ascontiguousarray(flat(right["pv"], right.num_rows).T)
            ids, other, t, u, cc, pp = (np.array(table[c]) for table, c in ((left, "child"), (right, "parent"), (left, "t"), (right, "u"), (left, "cc"), (right, "pp")))
            for at in range(0, len(ids), CHILDREN_AT_ONCE):
                own = slice(at, at + CHILDREN_AT_ONCE)
                fits = (u < t[own, None]) & (u >= t[own, None] - max_lag_s) & (other != ids[own, None])
                if not fits.any():
                    continue
                with np.errstate(all="ignore"):
                    score = np.zeros(fits.shape)
                    for d in range(len(theirs)):
                        score += mine[own, d, None] * theirs[d]
                    norms = np.sqrt(cc[own, None] * pp)
                    score /= norms
                i, j = np.nonzero(fits & ~(norms <= 0) & ~(score < least))  # what is not a number comes first, as in Spark
                value = score[i, j]
                if most is not None:
                    order = np.lexsort((j, np.where(np.isnan(value), -np.inf, -value), i))
                    place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
                    keep = order[place < most]
                    i, j, value = i[keep], j[keep], value[keep]
                found.append((ids[own][i], other[j], value))
        a, b, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"child": pa.array(a, pa.int64()), "parent": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return children.groupBy(*blocks).cogroup(parents.groupBy(*blocks)).applyInArrow(block, "child long, parent long, score double")


def best_candidates(candidates: DataFrame, most: int = 50) -> DataFrame:
    """Each child's `most` best candidates, ties to the lower parent. They are cut, and staged, before anything joins them."""
    place = F.row_number().over(W.partitionBy("child").orderBy(F.desc("score"), "parent"))
    return stage(candidates.withColumn("place", place).where(F.col("place") <= most), "best-candidates")


def mutation_edges(best: DataFrame, said: DataFrame, evolved: float, similar: float) -> DataFrame:
    """(child, parent, kind, score): of each child's best candidates (child, parent, score, place), the first that says
    something else and reaches `evolved` is its parent (EVOLVED_FROM); the others that reach `similar` are SIMILAR_TO.

    said: (id, said), a short digest of what is said; nulls tell nothing apart.
    """
    ranked = best.join(said.toDF("child", "__x"), "child").join(said.toDF("parent", "__y"), "parent").withColumn("meaningful", F.col("__x") != F.col("__y"))
    fits = F.col("meaningful") & (F.col("score") >= evolved)
    first = F.min(F.when(fits, F.col("place"))).over(W.partitionBy("child"))
    named = ranked.withColumn("kind", F.when(F.col("place") == first, "EVOLVED_FROM").when(F.col("score") >= similar, "SIMILAR_TO"))
    return named.where("kind is not null").select("child", "parent", "kind", F.round("score", 4).alias("score"))
