"""Near-duplicate vectors by p-stable hashing and exact cosine.

Vectors are brought to unit length; within a label and a dimension, equal vectors form a class. Each table hashes a
class's vector by several quantised random projections floor((a.v + b) / width), a from a normal (2-stable) law. Classes
in one bucket of one table are compared by cosine in double precision, in blocks of `BLOCK` rows: a bucket larger than
that is split, and each block meets every other block of its bucket in a segment of its own. A pair that shares several
buckets counts in the first of them only (each row carries all its keys). Tasks return sums of linked copies and a
spanning forest of the links, never the list of all pairs of a bucket.

How many projections a table has follows from the number of classes (`table_shape`): two vectors far apart share one
with probability 0.41, so each further projection keeps buckets as small for 2.4 times the classes; two at the least
cosine, 0.2 apart, share one with probability 0.90. The number of tables follows from that: a pair at the limit is
missed in all tables with probability below 1e-5, and closer pairs more rarely. Work grows with the number of classes
to the power 1.12, besides what true links need.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
id, link with nothing and are kept; equal vectors link; vectors of different length never do; ids are meant to be unique,
and rows that repeat an id count as copies of each other; very long vectors are compared whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.forest import spanning_forest
from newsloom.llm.word_hashes import mix
from newsloom.operators.components import connected_components
from newsloom.plans.staging import stage

LEAST_COSINE = 0.98
WIDTH = 1.6
#: Chances that vectors at the least cosine, and such as have nothing in common, share the cell of one projection.
NEAR_SHARED, FAR_SHARED = 0.9, 0.41
#: Classes that a bucket holds on average if none are similar, and the chance that a pair at the limit is missed.
FILL, MISSED = 32, 1e-5
BLOCK, TASK_ROWS = 1024, 2000
SEED = 7


def table_shape(classes: int) -> tuple[int, int]:
    """(tables, projections in each) for so many classes."""
    hashes = max(4, ceil(log(max(1, classes) / FILL) / -log(FAR_SHARED)))
    return ceil(log(MISSED) / log(1 - NEAR_SHARED**hashes)), hashes


@cache
def _projections(dimension: int, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dimension])
    return rng.standard_normal((dimension, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes)


def table_keys(unit: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """(rows, tables) bucket keys of unit vectors."""
    directions, offsets = _projections(unit.shape[1], tables, hashes)
    cells = np.floor((unit @ directions + offsets) / WIDTH).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(unit), tables, hashes)
    keys = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), (len(unit), tables)).copy()
    for k in range(hashes):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return keys.view(np.int64)


def usable(vector: Column) -> Column:
    """True for a vector that can link: present, finite in every component and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, rows: int) -> np.ndarray:
    """Vectors of one length, brought to unit length in double precision."""
    v = np.array(column.flatten(), np.float64).reshape(rows, -1)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _keyed(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    """classes (rep, copies, v, label) with `keys`, one per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column(2).value_lengths())
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                keys[at] = table_keys(_units(batch.column(2).take(pa.array(at)), len(at)), tables, hashes)
            ends = pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=[*batch.schema.names, "keys"])

    return classes.mapInArrow(run, f"rep long, copies long, v {classes.schema['v'].dataType.simpleString()}, label string, keys array<long>")


def _segment_links(side: np.ndarray, unit: np.ndarray, keys: np.ndarray, table: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with cosine >= least of one segment (sides 0 and 1, or all of side 0) met first in this table."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(right)
    right = left if within else right
    a, b = np.nonzero(unit[left] @ unit[right].T >= least)
    a, b = left[a], right[b]
    if within:
        a, b = a[a < b], b[a < b]
    if table:
        first = ~(keys[a, :table] == keys[b, :table]).any(1)
        a, b = a[first], b[first]
    return a, b


def _links(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, n): with b null, n copies linked to class a; else a link of classes a > b. rows: placed in segments of tasks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment").combine_chunks()
        segment, at, side, ids, copies = (np.array(table[c]) for c in ("segment", "at", "side", "rep", "copies"))
        v, keys = table["v"].combine_chunks(), table["keys"].combine_chunks()
        sums, high, low = np.zeros(len(ids), np.int64), [], []
        edges = np.flatnonzero(np.diff(segment)) + 1
        for start, end in zip([0, *edges], [*edges, len(ids)]):
            unit = _units(v.slice(start, end - start), end - start)
            own = np.array(keys.slice(start, end - start).flatten()).reshape(end - start, -1)
            a, b = _segment_links(side[start:end], unit, own, at[start], least)
            a, b = a + start, b + start
            np.add.at(sums, a, copies[b])
            np.add.at(sums, b, copies[a])
            high.append(ids[a])
            low.append(ids[b])
        some = np.flatnonzero(sums)
        a, b = spanning_forest(np.concatenate(high), np.concatenate(low))
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[some], a]), pa.int64()),
                "b": pa.array([*[None] * len(some), *b.tolist()], pa.int64()),
                "n": pa.array(np.concatenate([sums[some], np.zeros(len(a), np.int64)]), pa.int64()),
            }
        )

    return rows.groupBy("task").applyInArrow(run, "a long, b long, n long")


def _segments(keyed: DataFrame) -> DataFrame:
    """(segment, at, side, rep): each bucket with several classes, by blocks beside blocks."""
    placed = keyed.select("rep", F.posexplode("keys").alias("at", "key"), "label", F.size("v").alias("d"))
    placed = placed.select("rep", "at", F.xxhash64("at", "key", "label", "d").alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    full = stage(full.select(F.col("bucket").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    met = placed.join(full, F.col("bucket") == F.col("k"))
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(block, o).alias("lo"), F.greatest(block, o).alias("hi"), (o < block).cast("int").alias("side")))
    dealt = met.select("rep", "at", "bucket", F.explode(others).alias("o"))
    return dealt.select(F.xxhash64("bucket", "o.lo", "o.hi").alias("segment"), "at", "o.side", F.col("rep").alias("r"))


def similar_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    number = "float" if kind == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast(number) + F.lit(0).cast(number)).alias("v"), F.col("label").cast("string"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    # length first and label last: no two pairs of vector and label have one digest
    digest = F.sha2(F.concat_ws(",", F.size("v").cast("string"), F.transform("v", lambda x: x.cast("string")), F.col("label")), 256)
    rows = stage(rows.select("vec_id", F.when(ok, F.col("v")).alias("v"), F.when(ok, F.col("label")).alias("label"), F.when(ok, digest).alias("digest")), "vectors")
    live = rows.where("digest is not null")
    sizes = stage(live.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumnRenamed("digest", "g"), "vector-classes")
    reps = live.join(sizes, (F.col("digest") == F.col("g")) & (F.col("vec_id") == F.col("rep"))).dropDuplicates(["digest"]).select("rep", "copies", "v", "label")
    keyed = stage(_keyed(reps, *table_shape(sizes.count())), "vector-keys")
    segments = stage(_segments(keyed), "vector-segments")
    tasks = max(1, -(-segments.count() // TASK_ROWS))
    dealt = segments.join(keyed, F.col("r") == F.col("rep")).select(F.pmod("segment", F.lit(tasks)).alias("task"), "segment", "at", "side", "rep", "copies", "v", "keys")
    found = stage(_links(dealt, least), "vector-links")
    counts = stage(found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked")), "vector-counts")
    groups = stage(connected_components(found.where("b is not null")), "vector-components")
    named = sizes.join(counts, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    named = stage(named.select("g", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c")), "vector-named")
    out = rows.join(named, F.col("digest") == F.col("g"), "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
