"""Whitening of vectors from exact bit-sliced cross-products.

Vectors are whole numbers; the fit list holds each distinct vector once. In each batch of the fit list every dimension
is shifted to start at zero and cut into bit planes; a plane packs its bit of 64 rows into one word. The products of two
dimensions summed over the batch are the bit counts of their planes' conjunctions, weighted by powers of two. Shifts are
undone in whole numbers, tasks return their sums, and Spark adds them by place. n times the products less the products
of the sums is the covariance times n squared, exact until it is divided and given to `eigh`.

Only sums, one number for each pair of dimensions, come to the driver; the model that goes back is `components` directions
and the sums. Rows pass through one map. The check of the result adds centred products of whitened vectors, mergeably.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped; null ids, repeated ids and
repeated vectors stay, and equal vectors count once in the fit; rows whose vector has not the most frequent length (of
equally frequent ones the longest) have no place in the space and are dropped as well; entries beyond a long stop at its
limits; a deviation beyond a long is null; components without variance (below rounding) are left out, so fewer than two
distinct vectors give no rows, nor does an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.staging import stage

COMPONENTS = 4
#: A whole number travels as digits of so many bits, so that sums over all tasks stay within longs.
DIGIT_BITS, DIGITS = 40, 5


@dataclass
class Model:
    """What one vector needs to be whitened: n, the sums S, unit directions by falling variance, and their variances."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """(dimensions * bits, words): plane `bits * i + p` holds bit p of dimension i, 64 rows to a word."""
    rows, width = shifted.shape
    padded = np.zeros((-(-rows // 64) * 64, width), np.uint64)
    padded[:rows] = shifted
    planes = [np.packbits(((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=0) for p in range(bits)]
    return np.ascontiguousarray(np.stack(planes).transpose(2, 0, 1)).reshape(width * bits, -1).view(np.uint64)


def cross_products(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact sums of each dimension and of the products of each two, from AND-popcounts of bit planes."""
    rows, width = x.shape
    low = x.min(0)
    span = [int(h) - int(m) for h, m in zip(x.max(0), low)]
    bits = max(1, max(span).bit_length())
    planes = bit_planes(x.view(np.uint64) - low.view(np.uint64), bits)
    counts = np.empty((len(planes), len(planes)), np.int64)
    for k in range(len(planes)):
        counts[k, k:] = np.bitwise_count(planes[k:] & planes[k]).sum(1, dtype=np.int64)
        counts[k:, k] = counts[k, k:]
    # whole numbers in doubles are exact below 2**53; beyond that Python's own are used
    kind = np.float64 if 2 * bits + rows.bit_length() < 53 else object
    weights = np.array([1 << p for p in range(bits)], object).astype(kind)
    cells = counts.reshape(width, bits, width, bits).astype(kind)
    shifted = (cells * weights[None, None, None, :]).sum(3)
    products = (shifted * weights[None, :, None]).sum(1)
    sums = (counts.diagonal().reshape(width, bits).astype(kind) * weights).sum(1)
    whole = lambda a: np.vectorize(int, otypes=[object])(a)
    sums, products, low = whole(sums), whole(products), whole(low)
    products = products + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)
    return list(sums + rows * low), products


def _digits(number: int) -> list[int]:
    """The number in base 2**DIGIT_BITS, lowest first; the highest digit carries the sign."""
    out = []
    for _ in range(DIGITS - 1):
        out.append(number & ((1 << DIGIT_BITS) - 1))
        number >>= DIGIT_BITS
    return [*out, number]


def _scatter(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the sums of products of the fit list (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).flatten(), np.int64).reshape(batch.num_rows, width)
                s, p = cross_products(x)
                n, sums, products = n + len(x), sums + np.array(s, object), products + p
        if n:
            cells = [(-1, -1, n), *((i, -1, sums[i]) for i in range(width)), *((i, j, products[i, j]) for i in range(width) for j in range(i, width))]
            digits = np.array([_digits(int(v)) for _, _, v in cells], np.int64)
            columns = [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), *(pa.array(digits[:, k]) for k in range(DIGITS))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *(f"d{k}" for k in range(DIGITS))])

    parts = fit.mapInArrow(run, "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS)))
    n, sums, products = 0, [0] * width, np.zeros((width, width), object)
    for r in parts.groupBy("i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)]).collect():  # one row for each two dimensions
        value = sum(r[f"d{k}"] << DIGIT_BITS * k for k in range(DIGITS))
        if r["i"] < 0:
            n = value
        elif r["j"] < 0:
            sums[r["i"]] = value
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = value
    return n, sums, products


def fit_model(fit: DataFrame, width: int, components: int = COMPONENTS) -> Model:
    n, sums, products = _scatter(fit, width)
    s = np.array(sums, object)
    centred = n * products - np.outer(s, s)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    trace = float(sum(int(centred[i, i]) for i in range(width)) / (n * n))
    kept = [k for k in range(width - 1, -1, -1) if values[k] > trace * width * np.finfo(float).eps * 4][:components]
    directions = vectors[:, kept]
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(len(kept))])
    return Model(n, sums, directions * signs, values[kept], trace)


def _whitened(rows: DataFrame, model: Model, keep: str, kind: str) -> DataFrame:
    """keep, deviation, w (one number for each component) for rows (keep, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(model.sums, object)
        size = max(abs(v) for v in model.sums)
        for batch in batches:
            x = np.array(batch.column(1).flatten(), np.int64).reshape(batch.num_rows, len(model.sums))
            most = model.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + size
            fits = len(s) * most * most < 2**63
            d = x * model.n - s.astype(np.int64) if fits else x.astype(object) * model.n - s
            squares = (d * d).sum(1)
            deviation = pa.array(squares, pa.int64()) if fits else pa.array([int(v) if v < 2**63 else None for v in squares], pa.int64())
            w = (d.astype(np.float64) / model.n) @ model.directions / np.sqrt(model.variances)
            ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=[keep, "deviation", "w"])

    return rows.select(keep, "x").mapInArrow(run, f"{keep} {kind}, deviation long, w array<double>")


def _identity_error(fit: DataFrame, model: Model) -> float:
    """The largest entry of the whitened fit list's covariance less the identity."""
    k = len(model.variances)
    w = _whitened(fit.withColumn("at", F.lit(0)), model, "at", "int")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = w.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error from vectors (vec_id, x), x whole numbers."""
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = vectors.schema["vec_id"].dataType.simpleString()
    usable = vectors.select("vec_id", "x").where("x is not null and size(x) > 0 and not exists(x, c -> c is null)")
    # without an order of its own, the list of distinct vectors keeps the number of partitions of its shuffle
    distinct = stage(usable.select("x", F.size("x").alias("width")).distinct(), "whitening-fit")
    widths = usable.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows"))
    common = widths.agg(F.max(F.struct("rows", "width")).alias("m")).first()["m"]
    nothing = vectors.sparkSession.createDataFrame([], schema.format(kind))
    if common is None:
        return nothing
    width = common["width"]
    fit = distinct.where(F.col("width") == width).select("x")
    model = fit_model(fit, width, components)
    if not len(model.variances):
        return nothing
    error = _identity_error(fit, model)
    w = _whitened(usable.where(F.size("x") == width), model, "vec_id", kind)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    placed = w.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return placed.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
