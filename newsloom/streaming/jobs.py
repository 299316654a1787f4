"""Structured Streaming forms of the incremental jobs. Each takes a streaming DataFrame and keeps state in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.plans.staging import new_folder


def event_stream(spark: SparkSession, folder: str, schema: str, time: str = "ts", name: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder (those whose name fits) as a stream with a timestamp that a watermark can use."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream once over what has arrived and return the rows written: all of them (append), or the last state
    (complete). What it writes goes with the session."""
    folder = new_folder(stream.sparkSession, f"stream-{name}")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    rows = stream.sparkSession.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return (rows.where(F.col("batch") == max(last)) if mode == "complete" else rows).drop("batch")


def first_by_url(stream: DataFrame, delay: str) -> DataFrame:
    """Rows whose url did not arrive before within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


def windowed_counts(stream: DataFrame, by: list[str], length: str = "24 hours", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows per window and key; rows later than the delay are left out, null times too."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = stream.where("ts is not null").withWatermark("ts", delay).groupBy(window, *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), *by, "n")


def surges(counts: DataFrame, by: list[str], floor: int, days: int = 1, factor: float = 2) -> DataFrame:
    """Windows with at least `floor` rows and `factor` times those of the window before (1 at least), from windowed_counts."""
    order = W.partitionBy(*by).orderBy("start")
    adjacent = F.lag("start").over(order) == F.col("start") - F.make_dt_interval(F.lit(days))
    prior = F.when(adjacent, F.lag("n").over(order)).otherwise(F.lit(0))
    rows = counts.withColumn("prior", F.coalesce(prior, F.lit(0)))
    return rows.where((F.col("n") >= floor) & (F.col("n") * 100 >= round(factor * 100) * F.greatest("prior", F.lit(1))))


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Windows and keys with more rows than the limit, from windowed_counts."""
    return counts.where(F.col("n") > limit)


def _version(spark: SparkSession, folder: str, before: int | None = None) -> int:
    """The last complete version of a table kept in folder/version=n (before a batch, if given); -1 if there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return -1
    found = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max([n for n in found if before is None or n < before], default=-1)


def versioned(stream: DataFrame, folder: str, step) -> DataFrame:
    """The table that step(table or None, batch) builds batch by batch, after all that has arrived.

    Version n of the table, folder/table/version=n, is written by batch n from the version before it. A batch that is
    repeated after a crash writes the same version again, and a stream that is started anew with the same folder goes on
    where it stopped. Versions before the last two are deleted. For small tables: each batch writes the whole one. The
    folder has to be one that driver and executors share.
    """
    spark, tables = stream.sparkSession, f"{folder.rstrip('/')}/table"

    def merge(batch: DataFrame, number: int) -> None:
        last = _version(spark, tables, number)
        before = spark.read.parquet(f"{tables}/version={last}") if last >= 0 else None
        step(before, batch).write.mode("overwrite").parquet(f"{tables}/version={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{tables}/version={_version(spark, tables, last)}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    stream.writeStream.option("checkpointLocation", f"{folder.rstrip('/')}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    last = _version(spark, tables)
    if last < 0:
        raise ValueError("the stream has had no batch yet")
    return spark.read.parquet(f"{tables}/version={last}")


def clustering_runs(stream: DataFrame, folder: str, least_new: int = 10, pause_s: int = 3600) -> DataFrame:
    """(run, at_s, rows_seen): when a stream (at_s) would have been clustered again.

    A batch starts a run if at least `least_new` rows have come since the last one and the batch's last time is at least
    `pause_s` after it; otherwise its rows wait for a later batch. run -1 holds what is waiting.
    """

    schema = "run int, at_s long, rows_seen long"

    def step(runs: DataFrame | None, batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        runs = spark.createDataFrame([], schema) if runs is None else runs
        came = batch.agg(F.count("*").alias("n"), F.max("at_s").alias("t")).first()
        past = runs.agg(F.max("run").alias("run"), F.max(F.when(F.col("run") >= 0, F.col("at_s"))).alias("at_s"), F.max(F.when(F.col("run") < 0, F.col("rows_seen"))).alias("waiting")).first()
        last, waiting = -1 if past["run"] is None else past["run"], (past["waiting"] or 0) + came["n"]
        new = []
        if came["t"] is not None and waiting >= least_new and (last < 0 or came["t"] - past["at_s"] >= pause_s):
            new, waiting = [(last + 1, came["t"], waiting)], 0
        return runs.where("run >= 0").unionByName(spark.createDataFrame([*new, (-1, None, waiting)], schema))

    return versioned(stream, folder, step)
