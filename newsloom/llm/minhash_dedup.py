"""Near-duplicate texts by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its five-word shingles. Each shingle owns a Poisson process over its weight levels: levels are
grouped in blocks [0,1), [1,2), [2,4), [4,8) ...; a block's process is split in halves, lazily and only around points
that are early enough to matter, until a point lies on one level. Levels at or above a shingle's count in the text do
not count. Every point goes to one of the signature's components, each of which keeps its earliest point, so two texts
agree in a component with a probability equal to the weighted Jaccard similarity of their multisets.

Copies are grouped by a digest of the multiset first. Representatives go to the buckets of 25 bands of 5 components.
A bucket's pairs are never written out. First every member is tried against the member with most company (the bucket's
hub); the links found give components. In buckets whose members are still in several components, those that are not in
the hub's component (the asked ones) are tried against all members of other components. Both steps work in segments: a
block of at most about `BLOCK` asked rows beside a block of as many others, each with its whole multiset. A task tries
the pairs of its segments by 128 signature bits (no pair of similarity 0.8 fails that but with probability below 1e-5)
and the sizes, then by the exact overlap of the two multisets, and returns a spanning forest of the links, not the pairs.
A pair that shares several buckets is tried in the first of them. Results do not depend on how rows are dealt.

Defined cases: null, empty and wordless texts link with nothing and are kept; a text of fewer than five words is one
shingle; very long texts are compared whole (a block holds fewer of them: `BLOCK_ITEMS`); of rows with one id and one
multiset exactly one is kept; rows of one id with several texts share their links; null ids are left out of links and
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsloom.llm.forest import spanning_forest
from newsloom.llm.memory import let_go, releasing
from newsloom.llm.text_columns import unused
from newsloom.llm.word_hashes import mix, shingle_hashes
from newsloom.operators.components import connected_components
from newsloom.plans.staging import stage

WIDTH = 5
COMPONENTS, BANDS, BAND_ROWS = 128, 25, 5
#: Least similarity as a fraction.
SIMILAR = (4, 5)
#: Most of 128 signature bits in which a pair may differ: 12.8 are expected at 0.8, with a deviation of 3.4.
MAX_BITS_APART = 29
#: Rows on either side of a segment, and shingles there, on average.
BLOCK, BLOCK_ITEMS = 256, 2_000_000
#: Rows and shingles of the segments that one task call gets, on average.
TASK_ROWS, TASK_ITEMS = 500, 2_000_000
#: Pairs of a segment up to which multisets are intersected pair by pair, and columns multiplied at once beyond that.
FEW_PAIRS, COLUMNS = 100, 2048
MAX_BROADCAST_IDS = 500_000
_STREAM = np.uint64(0xD1342543DE82EF95)


def _nth(k: int) -> np.uint64:
    return np.uint64(int(_STREAM) * k % 2**64)


def _exponential(seed: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    bits = mix(seed + np.asarray(count, np.uint64) * _STREAM)
    return -np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52)


def _points(elements: np.ndarray, counts: np.ndarray, limit: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Components and times of all points up to limit on levels below each element's count."""
    top = int(counts.max())
    seeds, lows, sizes, weights = [mix(elements)], [np.zeros(len(elements), np.int64)], [np.ones(len(elements), np.int64)], [counts]
    low = 1
    while low < top:
        some = counts > low
        size = low
        seeds.append(mix(elements[some] + _nth(low)))
        lows.append(np.full(some.sum(), low))
        sizes.append(np.full(some.sum(), size))
        weights.append(counts[some])
        low += size
    seed, low_, size, weight = map(np.concatenate, (seeds, lows, sizes, weights))
    time = _exponential(seed, 0) / (m * size)
    early = time <= limit
    seed, low_, size, weight, time = seed[early], low_[early], size[early], weight[early], time[early]
    unit_seed, unit_time = [seed[size == 1]], [time[size == 1]]
    wide = size > 1
    seed, low_, size, weight, time = seed[wide], low_[wide], size[wide], weight[wide], time[wide]
    while len(seed):
        half = size // 2
        right = (mix(seed + _nth(1)) >> np.uint64(63)).astype(bool)
        ends = []
        for side in (False, True):
            child = mix(seed ^ np.uint64(0xA5A5A5A5 + side))
            has = right == side
            ends.append((child, low_ + half * side, half, weight, np.where(has, time, time + _exponential(child, 0) / (m * half))))
        seed, low_, size, weight, time = (np.concatenate(x) for x in zip(*ends))
        alive = (time <= limit) & (low_ < weight)
        seed, low_, size, weight, time = seed[alive], low_[alive], size[alive], weight[alive], time[alive]
        done = size == 1
        unit_seed.append(seed[done])
        unit_time.append(time[done])
        seed, low_, size, weight, time = seed[~done], low_[~done], size[~done], weight[~done], time[~done]
    seed, time = np.concatenate(unit_seed), np.concatenate(unit_time)
    slots, times = [(mix(seed + _nth(2)) % np.uint64(m)).astype(np.int64)], [time]
    at = 1
    steps = 1 + int(np.ceil(m * limit))
    while len(seed):
        counter = np.arange(at, at + steps, dtype=np.uint64)[None, :] * np.uint64(2)
        later = time[:, None] + np.cumsum(_exponential(seed[:, None], counter + np.uint64(1)), 1) / m
        keep = later <= limit
        slot = (mix(seed[:, None] + (counter + np.uint64(2)) * _STREAM) % np.uint64(m)).astype(np.int64)
        slots.append(slot[keep])
        times.append(later[keep])
        more = keep[:, -1]
        seed, time = seed[more], later[more, -1]
        at += steps
    return np.concatenate(slots), np.concatenate(times)


def bag_signature(elements: np.ndarray, counts: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """The earliest point of each component, as a float; elements are distinct hashes, counts positive integers."""
    limit = (np.log(m) + 3) / float(counts.sum())
    while True:
        slots, times = _points(elements, counts.astype(np.int64), limit, m)
        out = np.full(m, np.inf)
        np.minimum.at(out, slots, times)
        if np.isfinite(out).all():
            return out
        limit *= 2


def describe(text: str | None) -> tuple[int, int, list[int], int, int, int] | None:
    """Digest (two numbers), band keys, 128 signature bits (two numbers) and shingles of a text; None without words."""
    shingles = shingle_hashes(text.encode(), WIDTH) if text else ()
    if not len(shingles):
        return None
    elements, counts = np.unique(shingles, return_counts=True)
    n = counts.astype(np.uint64)
    digest = [mix(elements * n + np.uint64(salt) * n * n).sum(dtype=np.uint64) for salt in (3, 5)]
    digest = mix(np.array(digest, np.uint64) + np.uint64(len(shingles)))
    values = mix(bag_signature(elements, counts).view(np.uint64))
    bands = np.arange(1, BANDS + 1, dtype=np.uint64) * _STREAM
    rows = values[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    for k in range(BAND_ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    bits = np.packbits((values & np.uint64(1)).astype(np.uint8)).view(np.int64)
    d = digest.view(np.int64)
    return int(d[0]), int(d[1]), bands.view(np.int64).tolist(), int(bits[0]), int(bits[1]), len(shingles)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, c0, c1, bands, s0, s1, size for each row; all but doc_id are null for a row without words or id."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "c0", "c1", "bands", "s0", "s1", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [describe(t.as_py()) or (None,) * 6 for t in part.column(1)]
                columns = [pa.array([d[k] for d in found], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id long, c0 long, c1 long, bands array<long>, s0 long, s1 long, size long")


def multisets(docs: DataFrame) -> DataFrame:
    """doc_id, items: the text's shingles in order of their numbers, the k-th occurrence of one told apart from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                s = np.sort(shingle_hashes(text.as_py().encode(), WIDTH))
                first = np.maximum.accumulate(np.where(np.diff(s, prepend=~s[:1]) != 0, np.arange(len(s)), 0))
                nth = (np.arange(len(s)) - first).astype(np.uint64)
                rows.append(np.sort(np.where(nth > 0, mix(s + nth * _STREAM), s).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "doc_id long, items array<long>")


def pick(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs whose doc_id is (left_semi) or is not (left_anti) in ids; ids are broadcast up to MAX_BROADCAST_IDS of them."""
    (name,) = unused(docs, "id")
    ids = ids.select(F.col("doc_id").alias(name))
    small = ids.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs["doc_id"] == F.col(name), how)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """(left, right) common items of the pairs marked; items are sorted and distinct. Other entries mean nothing."""
    out = np.zeros(pairs.shape)
    if pairs.sum() <= FEW_PAIRS:
        for i, j in zip(*np.nonzero(pairs)):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    flat = [np.concatenate(left), np.concatenate(right)]
    common = np.intersect1d(*flat)
    placed = []
    for rows, items in zip((left, right), flat):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(common, items), max(0, len(common) - 1))
        keep = common[at] == items if len(common) else np.zeros(len(items), bool)
        order = np.argsort(at[keep], kind="stable")
        placed.append((row[keep][order], at[keep][order]))
    for start in range(0, len(common), COLUMNS):
        dense = []
        for rows, (row, at) in zip((left, right), placed):
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            block = np.zeros((len(rows), COLUMNS), np.float32)
            block[row[lo:hi], at[lo:hi] - start] = 1
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out


class _Rows:
    """The columns of a task's rows as arrays."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.segment, self.side, self.ids, self.component, self.at = (np.array(table[c]) for c in ("segment", "side", "doc_id", "component", "at"))
        self.asked = np.array(table["asked"].cast(pa.int8()), bool)
        self.keys = np.array(table["bands"].combine_chunks().flatten()).reshape(len(self.ids), BANDS)
        bits = np.column_stack([np.array(table["s0"]), np.array(table["s1"])]).view(np.uint8)
        self.signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
        items = table["items"].combine_chunks()
        self.flat, self.ends = np.array(items.flatten()), np.cumsum(np.array(items.value_lengths()))
        self.sizes = np.diff(self.ends, prepend=0)

    def items(self, at: np.ndarray) -> list[np.ndarray]:
        return [self.flat[self.ends[i] - self.sizes[i] : self.ends[i]] for i in at]


def _segment_links(rows: _Rows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the similar pairs of one segment, given the places of its rows."""
    left, right = at[rows.side[at] == 0], at[rows.side[at] == 1]
    num, den = SIMILAR
    sizes = rows.sizes[left][:, None], rows.sizes[right][None]
    pairs = rows.signs[left] @ rows.signs[right].T >= COMPONENTS - 2 * MAX_BITS_APART
    pairs &= den * np.minimum(*sizes) >= num * np.maximum(*sizes)
    pairs &= rows.component[left][:, None] != rows.component[right][None]
    pairs &= ~rows.asked[right][None] | (rows.ids[left][:, None] < rows.ids[right][None])
    for band in range(rows.at[at[0]]):
        pairs &= rows.keys[left, band][:, None] != rows.keys[right, band][None]
    left, right = left[pairs.any(1)], right[pairs.any(0)]
    pairs = pairs[pairs.any(1)][:, pairs.any(0)]
    if not len(left):
        return left, right
    common = overlaps(rows.items(left), rows.items(right), pairs)
    enough = pairs & (common * (num + den) >= num * (rows.sizes[left][:, None] + rows.sizes[right][None]))
    a, b = np.nonzero(enough)
    return rows.ids[left[a]], rows.ids[right[b]]


def _links(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Staged (a, b), a > b: for each task a spanning forest of the similar pairs of its segments.

    placed: segment, side (0 or 1), doc_id, component, at, bands, s0, s1, size, asked. A pair has one row of either side
    and two components; rows of side 1 that are asked too meet only smaller ids; bands before `at` must all differ.
    """
    placed = stage(placed, "near-placed")
    total = placed.agg(F.count("*").alias("rows"), F.sum("size").alias("items")).first()
    tasks = max(1, -(-total["rows"] // TASK_ROWS), -(-(total["items"] or 0) // TASK_ITEMS))
    ids = stage(placed.select("doc_id").distinct(), "near-ids")
    sets = stage(multisets(pick(docs.where("text is not null"), ids)).withColumnRenamed("doc_id", "d"), "near-multisets")

    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table)
        order = np.argsort(rows.segment, kind="stable")
        found = [_segment_links(rows, at) for at in np.split(order, np.flatnonzero(np.diff(rows.segment[order])) + 1)]
        a, b = spanning_forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        del rows, found
        let_go()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = placed.join(sets, F.col("doc_id") == F.col("d")).drop("d", "size")
    dealt = dealt.withColumn("task", F.pmod("segment", F.lit(tasks)))
    return stage(dealt.groupBy("task").applyInArrow(run, "a long, b long"), "near-links")


def _blocks(rows: str, items: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(items) / BLOCK_ITEMS), F.lit(1)).cast("int")


def _block(blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), blocks).cast("int")


def _each(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def _hubs(full: DataFrame) -> DataFrame:
    """(k, hub) for each bucket: the member whose buckets have most members, the smallest id of equals."""
    company = stage(full.groupBy("doc_id").agg(F.sum("n").alias("company")).withColumnRenamed("doc_id", "d"), "near-company")
    joined = full.join(company, F.col("doc_id") == F.col("d"))
    best = joined.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("minus"))).alias("best"))
    return stage(best.select(F.col("bucket").alias("k"), (-F.col("best.minus")).alias("hub")), "near-hubs")


def _star_segments(full: DataFrame, hubs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows for _links: each hub beside blocks of the members of its buckets, every member once for each hub."""
    met = full.join(hubs, F.col("bucket") == F.col("k")).where("doc_id <> hub").select("hub", "doc_id", "size").distinct()
    met = stage(met, "near-star")
    per_hub = met.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("items"))
    per_hub = stage(per_hub.select(F.col("hub").alias("h"), _blocks("n", "items").alias("blocks")), "near-star-sizes")
    members = met.join(per_hub, F.col("hub") == F.col("h")).select("hub", _block(F.col("blocks"), 1).alias("block"), F.lit(1).alias("side"), "doc_id")
    own = per_hub.select(F.col("h").alias("hub"), _each(F.col("blocks")).alias("block"), F.lit(0).alias("side"), F.col("h").alias("doc_id"))
    both = members.unionByName(own).select(F.xxhash64("hub", "block").alias("segment"), "side", "doc_id")
    return both.join(marks, F.col("doc_id") == F.col("m")).select(
        "segment", "side", "doc_id", F.col("doc_id").alias("component"), F.lit(0).alias("at"), "bands", "s0", "s1", "size", (F.col("side") == 0).alias("asked")
    )


def _rest_segments(full: DataFrame, hubs: DataFrame, groups: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows for _links: in each bucket with several components, blocks of asked rows beside blocks of all rows."""
    rows = full.join(groups, F.col("doc_id") == F.col("d"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("d", "n")
    rows = stage(rows, "near-grouped")
    main = rows.join(hubs, (F.col("bucket") == F.col("k")) & (F.col("doc_id") == F.col("hub"))).select("k", F.col("component").alias("main"))
    rows = stage(rows.join(stage(main, "near-main"), F.col("bucket") == F.col("k")).withColumn("asked", F.col("component") != F.col("main")).drop("k", "main"), "near-rows")
    asked = F.col("asked").cast("long")
    sizes = rows.groupBy("bucket").agg(F.sum(asked).alias("q"), F.sum(asked * F.col("size")).alias("q_items"), F.count("*").alias("n"), F.sum("size").alias("items"))
    sizes = sizes.where("q > 0").select(F.col("bucket").alias("k"), _blocks("q", "q_items").alias("asked_blocks"), _blocks("n", "items").alias("all_blocks"))
    rows = rows.join(stage(sizes, "near-mixed"), F.col("bucket") == F.col("k")).drop("k")
    left = rows.where("asked").withColumn("lo", _block(F.col("asked_blocks"), 2)).withColumn("hi", _each(F.col("all_blocks"))).withColumn("side", F.lit(0))
    right = rows.withColumn("hi", _block(F.col("all_blocks"), 3)).withColumn("lo", _each(F.col("asked_blocks"))).withColumn("side", F.lit(1))
    both = left.unionByName(right).select(F.xxhash64("bucket", "lo", "hi").alias("segment"), "side", "doc_id", "component", "at", "asked")
    return both.join(marks, F.col("doc_id") == F.col("m")).drop("m")


def near_classes(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(k0, k1, class_id): the class of each multiset digest of signed (see signatures), found among the texts of docs."""
    classes = stage(signed.where("c0 is not null").groupBy("c0", "c1").agg(F.min("doc_id").alias("rep")), "near-classes")
    same = (F.col("doc_id") == F.col("rep")) & (F.col("c0") == F.col("k0")) & (F.col("c1") == F.col("k1"))
    reps = signed.join(classes.select("rep", F.col("c0").alias("k0"), F.col("c1").alias("k1")), same).dropDuplicates(["doc_id", "c0", "c1"])
    reps = stage(reps.select("doc_id", "bands", "s0", "s1", "size"), "near-reps")
    rows = reps.select("doc_id", "size", F.posexplode("bands").alias("at", "bucket"))
    sizes = stage(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("bucket", "k"), "near-sizes")
    full = stage(rows.join(sizes, F.col("bucket") == F.col("k")).drop("k"), "near-full-buckets")
    marks = reps.withColumnRenamed("doc_id", "m")
    hubs = _hubs(full)
    links = _links(docs, _star_segments(full, hubs, marks))
    groups = stage(connected_components(links).withColumnRenamed("node", "d"), "near-components")
    links = links.union(_links(docs, _rest_segments(full, hubs, groups, marks)))
    groups = stage(connected_components(links).withColumnRenamed("node", "d"), "near-components")
    named = classes.join(groups, F.col("rep") == F.col("d"), "left")
    return stage(named.select(F.col("c0").alias("k0"), F.col("c1").alias("k1"), F.coalesce("component", "rep").alias("class_id")), "near-class-ids")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group of near-duplicates), kept for each row.

    kept: doc_id = class_id, and of rows with one id and one multiset only the first.
    """
    docs = docs.select("doc_id", "text")
    signed = stage(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    named = near_classes(signed, docs)
    # one row per id and multiset: copies are summed before hot digests meet their class
    rows = signed.where("c0 is not null").groupBy("doc_id", "c0", "c1").agg(F.min("row").alias("first"))
    rows = stage(rows.join(named, (F.col("c0") == F.col("k0")) & (F.col("c1") == F.col("k1"))).drop("k0", "k1"), "near-named")
    shared = rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).withColumnRenamed("doc_id", "d")
    found = rows.drop("class_id").join(shared, F.col("doc_id") == F.col("d")).drop("doc_id")
    found = stage(found.withColumnsRenamed({"c0": "k0", "c1": "k1"}), "near-found")
    own = (F.col("doc_id") == F.col("d")) & (F.col("c0") == F.col("k0")) & (F.col("c1") == F.col("k1"))
    out = signed.join(found, own, "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    kept = (F.col("doc_id") == F.col("class_id")) & F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    return out.select("doc_id", "class_id", F.coalesce(kept, F.lit(True)).alias("kept"))


def _with_digest(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with two more columns: the digest of each row's multiset (null without words)."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(describe(t.as_py()) or (None, None))[:2] for t in batch.column(at)]
            digests = [pa.array([d[k] for d in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *digests], names=[*batch.schema.names, *names])

    return docs.mapInArrow(releasing(run), StructType([*docs.schema, *[StructField(n, LongType()) for n in names]]))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest id; columns as before.

    Rows without words or without an id stay. Of rows with one id and one multiset one stays.
    """
    found = stage(near_duplicates(docs).where("not kept"), "near-dropped")
    others = found.where("doc_id <> class_id").select("doc_id").distinct()
    again = stage(found.where("doc_id = class_id").select("doc_id").distinct(), "near-again")
    if again.isEmpty():
        return pick(docs, others, "left_anti")
    digest = unused(docs, "c0", "c1")
    once = _with_digest(pick(docs, again), digest).dropDuplicates(["doc_id", *digest]).drop(*digest)
    return pick(docs, others.union(again), "left_anti").unionByName(once)
