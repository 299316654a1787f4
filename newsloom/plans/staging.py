"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests on one machine), a new temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = sc.getCheckpointDir()
    if not folder:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-newsloom-"))
        folder = sc.getCheckpointDir()
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/newsloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor costs no recomputation beyond it.

    The table goes when the session's JVM ends, or earlier with `unstage`.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete tables that `stage` returned and that no later result reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def attach(big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, max_broadcast_rows: int = 50_000, salts: int = 64, hot_rows: int = 4_000) -> DataFrame:
    """Left join of big to small on keys (nulls equal), with no task holding a whole hot key.

    small is counted first: up to max_broadcast_rows it is broadcast. Beyond that both sides are sorted, never broadcast:
    Spark guesses the size of repeated rows from the files before. Rows of big whose key has more than hot_rows take one
    of `salts` salts from the column spread_by, and small's rows of these keys alone are repeated once for each salt.
    """
    named = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = [big[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    if small.count() <= max_broadcast_rows:
        joined = big.join(F.broadcast(named), same, "left")
    else:
        hot = big.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows)
        hot = stage(hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.lit(True).alias("__hot")), "hot-keys")
        if hot.count() <= max_broadcast_rows:
            marked = lambda df, own: df.join(F.broadcast(hot), [df[own.format(k)].eqNullSafe(F.col(f"__hot_{k}")) for k in keys], "left").drop(*[f"__hot_{k}" for k in keys])
            left, right = marked(big, "{}"), marked(named, "__{}")
        else:
            left, right = (df.withColumn("__hot", F.lit(True)) for df in (big, named))
        last = F.when(F.col("__hot"), salts - 1).otherwise(0)
        salted = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0), last))).drop("__hot")
        left = left.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
        same = [left[k].eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__salt") == F.col("__salt2")]
        joined = left.join(salted.hint("merge"), same, "left").drop("__salt", "__salt2")
    return joined.drop(*[f"__{k}" for k in keys])


def only(big: DataFrame, some: DataFrame, key: str, max_broadcast_rows: int = 500_000) -> DataFrame:
    """Rows of big (wide: texts, sets) whose key is among those of some, which are staged and counted: up to
    max_broadcast_rows of them are broadcast, and big does not move."""
    keys = stage(some.select(key).distinct(), "keys")
    return big.join(F.broadcast(keys) if keys.count() <= max_broadcast_rows else keys.hint("merge"), key, "left_semi").select(*big.columns)


def meet(left: DataFrame, right: DataFrame, keys: list[str], spread_left: str, spread_right: str, block_rows: int = 4_000) -> DataFrame:
    """Inner join on keys (nulls meet nothing), with no task holding a whole hot key. Sides share no column but the keys."""
    ours, theirs, blocks = in_blocks(left, right, keys, spread_left, spread_right, block_rows)
    return ours.join(theirs, blocks).drop("__l", "__r")


def in_blocks(left: DataFrame, right: DataFrame, keys: list[str], spread_left: str, spread_right: str, block_rows: int = 4_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt into blocks, and the columns by which blocks meet.

    Rows of both sides are counted by key. A key of more than block_rows rows is split on each side into as many parts as
    it has blocks, by a hash of the columns spread_left and spread_right, and each part of one side meets each part of the
    other in a group of its own; rows of other keys are not repeated.
    """
    both = left.select(*keys).union(right.select(*keys)).groupBy(*keys).agg(F.count("*").alias("__n"))
    hot = stage(both.where(F.col("__n") > block_rows).select(*keys, F.ceil(F.col("__n") / block_rows).cast("int").alias("__parts")), "hot-keys")
    parts = F.coalesce(F.col("__parts"), F.lit(1))

    def dealt(rows: DataFrame, spread_by: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(F.col(spread_by)), parts).cast("int").alias(own)
        return attach(rows, hot, keys, spread_by).select(*rows.columns, part, F.explode(F.sequence(F.lit(0), parts - 1)).alias(other))

    return dealt(left, spread_left, "__l", "__r"), dealt(right, spread_right, "__r", "__l"), [*keys, "__l", "__r"]


def running_counts(counts: DataFrame, bucket: str, n: str, within: list[str] | None = None, group_bits: int = 10) -> DataFrame:
    """Adds `before`: the sum of n over all smaller buckets (of the same `within` columns).

    Two levels: sums of 2**group_bits buckets first, so that no window holds every bucket.
    """
    from pyspark.sql import Window as W

    within = within or []
    wide = counts.withColumn("__group", F.shiftright(F.col(bucket), group_bits))
    groups = wide.groupBy(*within, "__group").agg(F.sum(n).alias("__n"))
    above = W.partitionBy(*within).orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0))).drop("__n")
    inside = W.partitionBy(*within, "__group").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    wide = wide.withColumn("__inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    right = groups.select(*[F.col(c).alias(f"__r_{c}") for c in [*within, "__group"]], "__above")
    same = [wide[c].eqNullSafe(right[f"__r_{c}"]) for c in [*within, "__group"]]
    joined = wide.join(right, same)
    return joined.withColumn("before", F.col("__above") + F.col("__inside")).select(*counts.columns, "before")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with `position` (from 1 in the given order) and running sums, own row included: new name -> column.

    The table is range partitioned by the order, numbered and staged; totals of the partitions, of which there are at
    most spark.sql.shuffle.partitions, give each one's offsets, so no window holds more than one partition. Rows that
    agree in the whole order fall into one partition: end it with a column that tells rows apart.
    """
    from pyspark.sql import Window as W

    placed = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    placed = stage(placed, "ordered")
    names = {"position": None, **sums}
    total = lambda c: F.count("*") if c is None else F.sum(c)
    parts = placed.groupBy("__part").agg(*[total(c).alias(f"__total_{n}") for n, c in names.items()])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__total_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in names])
    upto = W.partitionBy("__part").orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(parts), F.col("__part") == F.col("__p"))
    found = joined.withColumns({n: (F.col(f"__before_{n}") + total(c).over(upto)) for n, c in names.items()})
    return found.select(*df.columns, *names)
