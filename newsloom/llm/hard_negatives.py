"""Hard negatives by slots of scores.

An anchor's positives are its best rows of the same label. Each positive opens a window of scores, from `low` to `high`
per cent of its own, and asks for the best rows of other labels within it. The windows' upper limits cut the scores into
disjoint slots. Anchors and rows are dealt into blocks; where two blocks meet, one matrix product scores them, and the
task keeps each anchor's best rows of each slot, no more than a window may return. Partial lists of a slot are merged by
rank. Slots are in falling order, so the list of a slot and all below it, a suffix, begins with the best rows that do not
exceed the slot's limit: every window is the head of one suffix, cut at its lower limit. Scores are exact integers.

Work is the number of anchors times the number of rows, the search that is asked for; no task holds more than one block
of each, and what it returns for an anchor is bounded by slots times ranks.

Defined cases: rows with a null id, a null label or vector, or a null or non-finite component take no part; rows of
different lengths do not meet; of rows that repeat an id the one of least label and vector takes part; ties go to the
smaller id; a score beyond a long stops at its limit; positives below zero have an empty window; an anchor without
positives or without rows in its windows gives no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.plans.staging import stage

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
ANCHOR_BLOCK, ROW_BLOCK = 16_384, 4_096
#: Anchors that a task scores in one product.
AT_ONCE = 256
TOP = 2**63 - 1


def all_finite(vector: Column) -> Column:
    """True for a vector that is present and whose components all are numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """Each component as the whole number below `scale` times it."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.array(column.flatten(), np.int64).reshape(len(column), -1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, stopped at the limits of a long."""
    size = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if a.shape[1] * size(a) * size(b) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -TOP, TOP).astype(np.int64)


def _slot_heads(scores: np.ndarray, out: np.ndarray, limits: list[np.ndarray], most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, slot, places of the best `most` in it) of a matrix whose columns are in the order that breaks ties.

    out: places that take no part. limits: each row's upper limits, falling.
    """
    bits = int(scores.shape[1] - 1).bit_length() + 1
    values = None
    if max(int(scores.max()), -int(scores.min())) >> (61 - bits):
        values, scores = np.unique(scores, return_inverse=True)
        scores = scores.reshape(out.shape)
    last = (1 << bits) - 1
    keys = (scores << bits) | (last - np.arange(scores.shape[1]))
    keys[out] = -TOP
    keys.sort(axis=1)
    absent = out.sum(1)
    for row, own in enumerate(limits):
        above = np.clip(own, -(1 << 61 - bits), (1 << 61 - bits) - 1) + 1 if values is None else np.searchsorted(values, own, "right")
        ends = np.maximum(np.searchsorted(keys[row], above << bits), absent[row])
        for slot, (start, end) in enumerate(zip([*ends[1:], absent[row]], ends)):
            if end > start:
                yield row, slot, last - (keys[row, max(start, end - most) : end] & last)


def _meet(anchors: DataFrame, rows: DataFrame, same_label: bool, most: int) -> DataFrame:
    """(q, slot, id, score): each anchor's best `most` rows of each slot, of its own label or of the others.

    anchors: (q, qx, q_label, limits); rows: (id, x, label).
    """
    blocks, asking = (max(1, -(-df.count() // size)) for df, size in ((rows, ROW_BLOCK), (anchors, ANCHOR_BLOCK)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.select("q", "qx", "q_label", "limits", F.size("qx").alias("d"), deal("q", asking).alias("asking"), every(blocks).alias("block"))
    dealt = rows.select("id", "x", "label", F.size("x").alias("d"), deal("id", blocks).alias("block"), every(asking).alias("asking"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            q, ids, a, b = np.array(left["q"]), np.array(right["id"]), _matrix(left["qx"]), _matrix(right["x"])
            limits = [np.array(x, np.int64) for x in left["limits"].to_pylist()]
            label = np.unique(np.concatenate([np.array(left["q_label"]), np.array(right["label"])]), return_inverse=True)[1]
            own, label = label[: len(q)], label[len(q) :]
            for at in range(0, len(q), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                scores = exact_products(a[part], b)
                out = ((own[part, None] == label[None, :]) != same_label) | (q[part, None] == ids[None, :])
                for row, slot, places in _slot_heads(scores, out, limits[part], most):
                    found.append((np.full(len(places), q[at + row]), np.full(len(places), slot), ids[places], scores[row, places]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 4
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(("q", "slot", "id", "score"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})

    keys = ("d", "block", "asking")
    met = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(best, "q long, slot int, id long, score long")
    place = F.row_number().over(W.partitionBy("q", "slot").orderBy(F.desc("score"), "id"))
    return met.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _share(percent: int, score: str, up: bool) -> Column:
    """percent * score / 100 for scores from 0 on, rounded up or down, without leaving the longs."""
    return F.expr(f"{percent} * ({score} div 100) + ({percent} * ({score} % 100) + {99 if up else 0}) div 100")


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vectors (vec_id, x, label).

    x: whole numbers. is_anchor: a condition on vec_id, x and label.
    """
    usable = vectors.where("vec_id is not null and label is not null and x is not null and not exists(x, c -> c is null)")
    one = usable.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("string").alias("label"), "x")).alias("r"))
    rows = stage(one.select("vec_id", "r.label", "r.x"), "negative-rows")
    base = rows.select(F.col("vec_id").alias("id"), "x", "label")
    asked = rows.where(is_anchor).select(F.col("vec_id").alias("q"), F.col("x").alias("qx"), F.col("label").alias("q_label"))
    best = stage(_meet(asked.withColumn("limits", F.array(F.lit(TOP))), base, True, positives), "positives")
    windows = best.where("score >= 0").select("q", F.col("id").alias("positive"), "score", _share(low, "score", True).alias("least"), _share(high, "score", False).alias("upper"))
    limits = windows.groupBy("q").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"))
    anchors = stage(asked.join(limits, "q"), "negative-anchors")
    heads = _meet(anchors, base, False, negatives)
    # at most `positives` slots of `negatives` rows for an anchor; slots fall, and so do the scores within each
    ordered = heads.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id"))).alias("heads"))
    asking = windows.join(anchors.select("q", "limits"), "q").join(ordered, "q")
    suffix = F.filter("heads", lambda e: (e["slot"] >= F.array_position("limits", F.col("upper")) - 1) & (-e["minus"] >= F.col("least")))
    taken = asking.select("q", "positive", "score", F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "n"))
    return taken.select(
        F.col("q").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"),
        F.col("score").alias("positive_score"),
        (-F.col("n.minus")).alias("negative_score"),
    )
