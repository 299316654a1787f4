"""Stateful jobs: state is keyed, kept by Spark between batches and restarts, and goes when its time is over.

Results are logs that only grow: each batch writes its own part, batch=n, once more if it is repeated after a crash, and
no part is ever written anew by a later batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State lies in RocksDB; a batch saves what it changed, not the whole store.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def append_log(changes: DataFrame, folder: str, mode: str, write=None) -> DataFrame | None:
    """Run a stream over what has arrived; (rows, batch) of every batch so far, or None before the first.

    write: makes the rows of a batch's part from the batch. The folder has to be one that driver and executors share.
    """
    spark, root = changes.sparkSession, folder.rstrip("/")

    def keep(batch: DataFrame, number: int) -> None:
        (write(batch, number) if write else batch).write.mode("overwrite").parquet(f"{root}/log/batch={number}")

    for name, value in _STATE.items():
        spark.conf.set(name, value)
    changes.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return read_log(spark, root)


def read_log(spark: SparkSession, folder: str, before: int | None = None, name: str = "log") -> DataFrame | None:
    """The parts of a log that are complete, with their batch; only those before a batch, if it is given."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    parts = [s.getPath() for s in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    parts = [str(p) for p in parts if before is None or int(p.getName().split("=")[1]) < before]
    return spark.read.option("basePath", str(root)).parquet(*parts) if parts else None


# ---------------------------------------------------------------- alerts


class _Registry(StatefulProcessor):
    """One alert: when it was first and last seen and acknowledged; forgotten `forget_s` after it was last seen."""

    def __init__(self, forget_s: int | None) -> None:
        self.forget_s = forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "first_s long, last_s long, acknowledged_s long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        first, last, acknowledged = self.alert.get() if self.alert.exists() else (None, None, None)
        earlier = last
        for row in rows:
            if row["acknowledge"]:
                acknowledged = row["at_s"] if acknowledged is None else min(acknowledged, row["at_s"])
            else:
                first, last = (row["at_s"], row["at_s"]) if first is None else (min(first, row["at_s"]), max(last, row["at_s"]))
        self.alert.update((first, last, acknowledged))
        if self.forget_s is not None and last is not None and last != earlier:
            if earlier is not None:
                self.handle.deleteTimer((earlier + self.forget_s) * 1000)
            self.handle.registerTimer((last + self.forget_s) * 1000)
        yield Row(kind=key[0], subject_key=key[1], first_s=first, last_s=last, acknowledged_s=acknowledged, forgotten=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        first, last, acknowledged = self.alert.get()
        self.alert.clear()
        yield Row(kind=key[0], subject_key=key[1], first_s=first, last_s=last, acknowledged_s=acknowledged, forgotten=True)

    def close(self) -> None:
        pass


def alert_registry(stream: DataFrame, folder: str, forget_s: int | None = None, delay: str = "1 hour") -> DataFrame:
    """(kind, subject_key, first_s, last_s, acknowledged_s) of the alerts known after all that has arrived.

    stream: (kind, subject_key, ts) and, if it has the column, acknowledge: rows that acknowledge an alert instead of
    raising it. First times and first acknowledgements stay, last times move on, whatever the order of arrival. State
    holds one row for each alert; with forget_s, an alert goes once the watermark (`delay` behind the last time) is so
    far past its last time, and one that comes again then starts anew. An acknowledgement of an alert that has not been
    raised waits for it. A batch writes only the alerts that it changed; the last change of each is the registry.
    """
    acknowledge = F.coalesce("acknowledge", F.lit(False)) if "acknowledge" in stream.columns else F.lit(False)
    rows = stream.where("ts is not null").select("kind", "subject_key", "ts", acknowledge.alias("acknowledge"))
    if forget_s is not None:
        rows = rows.withWatermark("ts", delay)
    rows = rows.withColumn("at_s", F.unix_seconds("ts"))
    schema = "kind string, subject_key string, first_s long, last_s long, acknowledged_s long, forgotten boolean"
    changes = rows.groupBy("kind", "subject_key").transformWithState(_Registry(forget_s), schema, "Update", "None" if forget_s is None else "EventTime")
    log = append_log(changes, folder, "update")
    if log is None:
        return stream.sparkSession.createDataFrame([], schema).drop("forgotten")
    # a batch without new rows may forget an alert that the batch before it has changed
    last = log.groupBy("kind", "subject_key").agg(F.max_by(F.struct("first_s", "last_s", "acknowledged_s", "forgotten"), F.struct("batch", "forgotten")).alias("r"))
    return last.where("not r.forgotten and r.first_s is not null").select("kind", "subject_key", "r.first_s", "r.last_s", "r.acknowledged_s")


# ---------------------------------------------------------------- near-duplicates within days

BANDS, ROWS = 22, 3
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = np.random.default_rng(12).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of a set of 64-bit shingles: permutations by multiplication, least values, ROWS to a band."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        permuted = shingles[at : at + 4096, None] * _MULTIPLIERS + _OFFSETS
        permuted ^= permuted >> np.uint64(29)
        permuted *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (permuted ^ (permuted >> np.uint64(32))).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ least.reshape(BANDS, ROWS)[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _banded(sets: DataFrame) -> DataFrame:
    """(id, at, n, key) rows, one for each band, from (id, at, n, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.array(s.values).view(np.uint64)) for s in batch.column(3)]
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            ends = pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(flat))], names=["id", "at", "n", "keys"])

    banded = sets.select("id", "at", "n", "s").mapInArrow(run, "id long, at timestamp, n int, keys array<long>")
    return banded.select("id", "at", "n", F.explode("keys").alias("key"))


def near_duplicate_pairs(stream: DataFrame, landed: DataFrame, folder: str, threshold: float = 0.75, window_s: int = 14 * 86_400, delay: str = "1 day") -> DataFrame:
    """(a, b, jaccard): near-duplicates among all articles (id, at_s, text) that have arrived, a collected first.

    The stream's articles go into an index of MinHash bands: the stream joins itself by the band's key within `window_s`,
    so state holds each band's articles of that time and Spark drops them when the watermark has passed it. Candidates are
    verified by exact similarity of word shingles against `landed`, the table that the stream reads, of which only the
    candidates' own articles and days are taken. Pairs at the threshold are missed with probability below 1e-5. Times that
    are null take no part; articles that come after the watermark are left out (`arrivals` names them).
    """
    from newsloom.operators.neardup import shingle_rows

    known = landed.select("id", "at_s", "text")

    def sets(rows: DataFrame) -> DataFrame:
        return shingle_rows(rows.where("at_s is not null"))

    timed = sets(stream.select("id", "at_s", "text")).withColumn("at", F.timestamp_seconds("at_s")).withWatermark("at", delay)
    banded = _banded(timed)
    names = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("id", "at", "n", "key")]
    near = F.expr(f"a_key = b_key and b_at >= a_at and b_at <= a_at + make_dt_interval(0, 0, 0, {window_s})")
    order = (F.col("a_at") < F.col("b_at")) | (F.col("a_id") < F.col("b_id"))
    sizes = F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - 1e-9
    met = banded.select(*names("a")).join(banded.select(*names("b")), near & (F.col("a_id") != F.col("b_id")) & order & sizes)
    candidates = met.select(F.col("a_id").alias("a"), F.unix_seconds("a_at").alias("a_s"), F.col("b_id").alias("b"), F.unix_seconds("b_at").alias("b_s"))

    def verified(batch: DataFrame, number: int) -> DataFrame:
        from newsloom.plans.staging import stage

        pairs = stage(batch.distinct(), "candidates")
        span = pairs.agg(F.min("a_s").alias("low"), F.max("b_s").alias("high")).first()
        low, high = (0, -1) if span["low"] is None else span
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        own = stage(sets(known.where(F.col("at_s").between(low, high)).join(ids, "id", "left_semi")).select("id", "s").dropDuplicates(["id"]), "candidate-sets")
        met = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
        scored = met.select("a", "b", (F.col("both") / (F.size("x") + F.size("y") - F.col("both"))).alias("jaccard"))
        return scored.where(F.col("jaccard") >= threshold)

    log = append_log(candidates, folder, "append", verified)
    if log is None:
        return stream.sparkSession.createDataFrame([], "a long, b long, jaccard double")
    return log.select("a", "b", "jaccard").distinct()


def canonical_articles(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, canonical_id): the earliest (then lowest) of each article's chain of near-duplicates, itself if it has none.

    articles: (id, at_s). A later arrival may join two chains; the answer is that for all that has arrived.
    """
    from newsloom.operators.components import connected_components

    groups = connected_components(pairs)
    named = articles.select("id", "at_s").join(groups, F.col("id") == F.col("node"), "left").select("id", "at_s", F.coalesce("component", "id").alias("c"))
    first = named.groupBy("c").agg(F.min(F.struct("at_s", "id")).alias("x")).select("c", F.col("x.id").alias("canonical_id"))
    return named.join(first, "c").select("id", "canonical_id")


# ---------------------------------------------------------------- late, future and unknown times


def arrivals(stream: DataFrame, folder: str, delay_s: int, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable, aside) of all rows (ts and others) that have arrived; aside has the reason why a row is not used.

    Unknown and future times (later than now) are named as such. A row is late if it is more than delay_s behind the
    latest usable time of the batches before its own, which is the watermark that a stateful operator over the usable
    rows would have reached. Each batch leaves that time beside its rows, so a repeated batch or a restarted stream
    decides alike. Every row of the stream is in one of the two tables.
    """
    spark, root = stream.sparkSession, folder.rstrip("/")

    def named(batch: DataFrame, number: int) -> DataFrame:
        marks = read_log(spark, root, number, "marks")
        last = marks.agg(F.max("last")).first()[0] if marks is not None else None
        future = F.col("ts") > F.lit(now).cast("timestamp") if now else F.lit(False)
        late = F.col("ts") < F.lit(last) - F.make_dt_interval(secs=F.lit(delay_s)) if last is not None else F.lit(False)
        reason = F.when(F.col("ts").isNull(), "unknown time").when(future, "future time").when(late, "late")
        rows = batch.withColumn("reason", reason)
        rows.where("reason is null").agg(F.max("ts").alias("last")).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")
        return rows

    log = append_log(stream, root, "append", named)
    if log is None:
        log = spark.createDataFrame([], stream.schema).withColumn("reason", F.lit(None).cast("string")).withColumn("batch", F.lit(0))
    return log.where("reason is null").drop("reason", "batch"), log.where("reason is not null").drop("batch")
