"""Mixing sources to target weights by repeating documents.

Tokens are summed for each source, targets follow from the weights, and a source's repetition rate is
target / tokens. Each document is emitted floor(rate) times, plus once more when a hash of its id, its text and its
number among equal rows, read as a number in [0, 1), is below the rate's fraction. The draw depends on the seed and
these alone, so reruns and lost tasks agree.

Defined cases: a null text has size 0; null is a source of its own, placed last; a source without words has target 0
and rate 0, so its documents are not emitted; null ids and ids that repeat draw by their texts, rows equal in both by
their number; very long texts count whole; an empty table gives an empty result; `mix_documents` keeps all columns of
whatever names, maps included (but not maps within other columns if ids repeat), and takes rows with equal values in all
of them as interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.text_columns import n_words, numbered_copies, packed, unit_interval, unpacked
from newsloom.plans.staging import attach, running_totals, stage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Repeated ids up to this count are broadcast.
MAX_BROADCAST_IDS = 500_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source from (source, size) rows: source, source_size, weight, target, rate.

    Sources by code point, null last, take the weights in turn. All targets together equal all sizes; none exceeds
    max_repeat times its source's size, and what is above goes to the others by weight. Ordered by size over weight,
    the stopped sources are the first ones, so running sums find the level at which the rest meet their share. Both
    orders are range partitions of the table of sources, so no task holds all sources, however many there are; the driver
    gets three numbers.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running_totals(per_source, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("position") - 1) % len(weights)).cast("int") + 1).cast("long")
    table = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(max_repeat)).alias("cap"))
    table = stage(table, "mix-weights")
    table = running_totals(table, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"caps": "cap", "weights": "weight"})
    whole = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    table = table.withColumns({"left_over": F.lit(whole["size"]) - F.col("caps") + F.col("cap"), "left_weight": F.lit(whole["weight"]) - F.col("weights") + F.col("weight")})
    table = stage(table.withColumn("stopped", F.col("weight") * F.col("left_over") > F.col("cap") * F.col("left_weight")), "mix-order")
    share = F.when(~F.col("stopped"), F.col("left_over") / F.col("left_weight"))
    level = table.agg(F.max_by(share, F.when(~F.col("stopped"), F.col("left_weight"))).alias("level")).first()["level"]
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level).cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return table.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def copies(rate: Column, *key: Column, seed: str = SEED) -> Column:
    """How often a document with this key is emitted at this rate."""
    whole = F.floor(rate)
    return (whole + F.when(unit_interval(seed, *key) < rate - whole, 1).otherwise(0)).cast("long")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows (id and others) with `copy`, the number among equal rows.

    Ids that several rows have are counted first; only rows of such ids are compared in all columns and numbered.
    """
    again = stage(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("k")), f"{name}-again")
    first = F.lit(1).cast("long").alias("copy")
    n = again.count()
    if not n:
        return rows.select("*", first)
    again = F.broadcast(again) if n <= MAX_BROADCAST_IDS else again
    same = rows["id"].eqNullSafe(again["k"])
    return rows.join(again, same, "left_anti").select("*", first).unionByName(numbered_copies(rows.join(again, same, "left_semi"), name))


def document_rates(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies for each row of docs (doc_id, text, source)."""
    sizes = stage(docs.select(F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size"), F.md5("text").alias("digest")), "mix-sizes")
    targets = stage(source_targets(sizes, weights, max_repeat), "mix-targets")
    joined = attach(_numbered(sizes, "mix-copies"), targets, ["source"], spread_by="digest")
    times = copies(F.col("rate"), F.col("id"), F.col("digest"), F.col("copy"), seed=seed)
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "rate", times.alias("copies"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """docs with each row repeated as its source's rate and its own draw say; columns as before."""
    sizes = docs.select("source", n_words(F.col("text")).alias("size"))
    targets = stage(source_targets(sizes, weights, max_repeat).select("source", "rate"), "mix-targets")
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), "source", F.md5("text").alias("digest"))
    joined = attach(_numbered(rows, "mix-numbered"), targets, ["source"], spread_by="digest")
    draw = copies(F.col("rate"), F.col("id"), F.col("digest"), F.col("copy"), seed=seed).cast("int")
    times = joined.select("row", draw.alias("times")).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select(*unpacked(docs, "row"))
