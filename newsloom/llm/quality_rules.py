"""Quality rules whose thresholds follow each language and source.

Per document: counts of words, symbols, repeated lines and repeated three-word windows. Each rule's value is an integer
number per ten thousand (or hundredths of a character). Values go into a quantile sketch of logarithmic buckets: below
64 a bucket holds one value, above it 32 buckets hold each power of two, so a quantile is off by 1/32 at most. A sketch
is a table (lang, source, rule, bucket, n): sketches merge by adding n, partial sums are made before the shuffle, and
the result does not depend on the order of merging. The limit of a rule is the upper quartile plus `reach` times its
distance from the median, and at least `resolution` above the median. Groups with fewer than `least_rows` rows use the
merged sketch of their language, then that of all rows.

Defined cases: null text and text without words: all counts 0, base_failed, not kept; null lang and null source are
groups of their own; equal rows count as often as they appear; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.text_columns import words
from newsloom.plans.staging import attach, stage

#: Rule name -> resolution: how far above the median a limit is at least, in the rule's own unit.
RULES = {"symbols": 300, "dup_lines": 150, "repeats": 2000, "word_length": 150}
REACH = 6
LEAST_ROWS = 30
MIN_WORDS = 50


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for whole texts.

    Three-word windows are compared by 64-bit hashes within one row; rows without a repeated window skip the sorting.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", "lang", "source", words(text).alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"), lines.alias("lines"))
    hashed = split.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    last = F.size("h") - 2
    windows = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.element_at("h", i), F.element_at("h", i + 1), F.element_at("h", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    windowed = hashed.withColumn("g", windows).drop("h")
    windowed = windowed.withColumn("again", F.size(F.array_distinct("g")) < F.size("g"))
    pairs = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    placed = windowed.withColumn("s", F.when(F.col("again"), pairs)).drop("g")
    n = F.size("s")
    repeated = F.filter(
        F.col("s"),
        lambda e, i: F.when(i > 0, e["h"] == F.get(F.col("s"), i - 1)["h"]).otherwise(F.lit(False)) | F.when(i < n - 1, e["h"] == F.get(F.col("s"), i + 1)["h"]).otherwise(F.lit(False)),
    )
    starts = placed.withColumn("p", F.when(F.col("again"), F.sort_array(F.transform(repeated, lambda e: e["at"])))).drop("s")
    covered = F.aggregate(
        F.col("p"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, at: F.struct((acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - at)).alias("n"), (at + 3).alias("end")),
    )["n"]
    return starts.withColumn("n_repeat_words", F.coalesce(F.when(F.col("again"), covered), F.lit(0)).cast("long")).drop("p", "again")


def rule_values() -> dict[str, Column]:
    """Each rule's value from document_counts: per ten thousand, and hundredths of a character for word_length."""
    return {
        "symbols": F.expr("n_symbols * 10000 div greatest(word_chars, 1)"),
        "dup_lines": F.expr("n_dup_lines * 10000 div greatest(n_words, 1)"),
        "repeats": F.expr("n_repeat_words * 10000 div greatest(n_words, 1)"),
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
    }


def bucket_of(value: Column) -> Column:
    """The sketch bucket of a non-negative integer: itself below 64, else its top six bits and its magnitude."""
    magnitude = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(magnitude * 32 + F.call_function("shiftright", value, magnitude)).cast("long")


def bucket_top(bucket: Column) -> Column:
    """The largest value of a bucket."""
    magnitude = F.floor((bucket - 32) / 32).cast("int")
    return F.when(bucket < 64, bucket).otherwise(F.call_function("shiftleft", bucket - magnitude * 32 + 1, magnitude) - 1).cast("long")


def sketch(values: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) from rows with lang, source and one column per rule."""
    stacked = values.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket_of(F.col(r)).alias("bucket")) for r in RULES])).alias("x"))
    return stacked.groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """keys, rule, n, top: a rule's limit from the median and the upper quartile of each sketch."""
    run = W.partitionBy(*keys, "rule").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    total = W.partitionBy(*keys, "rule")
    placed = sketches.withColumn("upto", F.sum("n").over(run)).withColumn("rows", F.sum("n").over(total))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * percent, F.col("bucket")))
    found = placed.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), bucket_top(at(50)).alias("mid"), bucket_top(at(75)).alias("upper"))
    least = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    return found.withColumn("top", F.greatest(F.col("upper") + reach * (F.col("upper") - F.col("mid")), F.col("mid") + least[F.col("rule")])).drop("mid", "upper")


def group_limits(values: DataFrame, reach: int = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per (lang, source): a limit for each rule, from the narrowest sketch with least_rows rows."""
    own = stage(sketch(values), "quality-sketch")
    narrow = limits(own, ["lang", "source"], reach)
    by_lang = limits(merge(own, ["lang"]), ["lang"], reach).select(F.col("lang").alias("__lang"), F.col("rule").alias("__rule"), F.col("rows").alias("lang_rows"), F.col("top").alias("lang_top"))
    overall = limits(merge(own, []), [], reach).select(F.col("rule").alias("__rule"), F.col("top").alias("all_top"))
    joined = narrow.join(by_lang, narrow["lang"].eqNullSafe(by_lang["__lang"]) & (narrow["rule"] == by_lang["__rule"])).drop("__rule")
    joined = joined.join(F.broadcast(overall), joined["rule"] == overall["__rule"])
    top = F.when(F.col("rows") >= least_rows, F.col("top")).when(F.col("lang_rows") >= least_rows, F.col("lang_top")).otherwise(F.col("all_top"))
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, top)).alias(f"top_{r}") for r in RULES])


def judge(docs: DataFrame, reach: int = REACH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """document_counts plus rule values, the group's limits, base_failed and kept."""
    counts = stage(document_counts(docs), "quality-counts")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    valued = counts.withColumns(rule_values()).withColumn("base_failed", base_failed)
    tops = stage(group_limits(valued.where(~F.col("base_failed")), reach, least_rows), "quality-limits")
    joined = attach(valued, tops, ["lang", "source"], spread_by="doc_id")
    over = F.lit(False)
    for rule in RULES:
        over = over | (F.col(rule) > F.col(f"top_{rule}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False)))
