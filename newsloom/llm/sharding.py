"""Shards that all have the corpus's mixture: proportional stratified interleaving.

Rows are ranked in a seeded random order within their source; rank r of n gets the fractional rank (r - u) / n, where u
in (0, 1) is drawn once for each source (so that sources of a few rows, of which there may be very many, do not meet at
one fraction); all rows sorted by it are cut into shards whose row counts differ by one at most. Each shard's count of a
source differs from the source's share by less than two.

No window holds a whole source or the whole table: rows are first dealt into narrow buckets of the hash (then of the
fractional rank), running counts of the buckets give each bucket's offset, and row_number runs inside a bucket only.
Rows that agree in id, source, size and checksum are counted first and numbered, so that copies have hashes of their own,
whatever their number. Joins of bucket counts are merge joins: nothing is broadcast.

Defined cases: a null text has no bytes and checksum 0; null is a source of its own; null and repeated ids are dealt like
any others; wholly equal rows are interchangeable; very long texts count by their size only; an empty table gives no
rows; with fewer rows than shards some shards are empty; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.text_columns import numbered_copies
from newsloom.plans.staging import running_counts, stage

SHARDS = 24
SEED = 20240501
ROWS_PER_BUCKET = 256


def _bits(rows: int) -> int:
    """Bits of a bucket number such that a bucket has about ROWS_PER_BUCKET of all rows; 6 to 40."""
    return min(40, max(6, (rows // ROWS_PER_BUCKET).bit_length()))


def interleave_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, position (from 0 over all rows), shard, slot (from 0 within the shard).

    size is the text's UTF-8 bytes plus 8 (a length prefix).
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", "source", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    key = F.xxhash64(F.lit(seed), "doc_id", "source", "size", "text_crc32", "copy")
    base = stage(numbered_copies(base, "shard-copies").withColumn("shuffle_key", key), "shard-rows")
    rows = base.count()
    bits = _bits(rows)
    per_source = base.groupBy("source").agg(F.count("*").alias("source_rows"))
    in_source = base.withColumn("bucket", F.shiftrightunsigned("shuffle_key", 64 - bits))
    counts = running_counts(in_source.groupBy("source", "bucket").agg(F.count("*").alias("n")), "bucket", "n", ["source"])
    counts = counts.join(per_source.withColumnRenamed("source", "__s").hint("merge"), F.col("source").eqNullSafe(F.col("__s")))
    counts = stage(counts.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), "before", "source_rows"), "shard-source-counts")
    joined = in_source.join(counts.hint("merge"), in_source["source"].eqNullSafe(counts["__s"]) & (in_source["bucket"] == counts["__b"]))
    order = ["shuffle_key", "doc_id", "text_crc32", "size", "copy"]
    rank = F.col("before") + F.row_number().over(W.partitionBy("source", "bucket").orderBy(*order))
    offset = (F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    fraction = (F.col("rank") - offset) / F.col("source_rows")
    ranked = joined.withColumn("rank", rank).withColumn("fraction", fraction)
    ranked = ranked.withColumn("part", F.least(F.floor(F.col("fraction") * F.lit(float(2**bits))), F.lit(2**bits - 1)).cast("long"))
    ranked = stage(ranked.select("doc_id", "source", "size", "text_crc32", "copy", "shuffle_key", "fraction", "part"), "shard-ranks")
    parts = running_counts(ranked.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    parts = stage(parts.select(F.col("part").alias("__p"), "before"), "shard-part-counts")
    tie = ["fraction", F.col("source").asc_nulls_last(), *order]
    position = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*tie)) - 1
    placed = ranked.join(parts.hint("merge"), ranked["part"] == parts["__p"]).withColumn("position", position)
    shard = F.expr(f"position * {n_shards}L div {max(1, rows)}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {rows}L + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "position", "shard", (F.col("position") - first).alias("slot"))
