"""Landed feed files as article rows: title, url, content, published_at, author, source."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.ranking import first_per_key

#: Quotes are doubled and nothing else is an escape: the default escape of an escape, NUL, would be lost beside quotes.
CSV_READ = {"header": True, "multiLine": True, "escape": '"', "charToEscapeQuoteEscaping": "\uffff"}
#: The same when writing; signs at a value's ends stay.
CSV_WRITE = {"header": True, "quoteAll": True, "escape": '"', "charToEscapeQuoteEscaping": "\uffff", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

_RSS = "title string, link string, description string, content string, pubDate string, updated string, author string"
_POST = "title string, url string, permalink string, selftext string, created_utc double, author string, subreddit string"
_NEWS = "status string, articles array<struct<title: string, url: string, content: string, description: string, publishedAt: string, author: string>>"


def _present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files; items without title or link are left out; content before description, publication before update."""
    items = spark.read.format("xml").option("rowTag", "item").schema(_RSS).load(path)
    stamp = lambda name: F.coalesce(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(name, "^[A-Za-z]{3}, ", ""), "(GMT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.col(name)))
    rows = items.where(_present(F.col("title")).isNotNull() & _present(F.col("link")).isNotNull())
    return rows.select(F.trim("title").alias("title"), F.trim("link").alias("url"), F.coalesce(_present(F.col("content")), F.col("description")).alias("content"), F.coalesce(stamp("pubDate"), stamp("updated")).alias("published_at"), "author")


def read_forum(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Posts of forum listings (a file each, or with `lines` a line each); the permalink before the target url; r/ is
    taken off the source's name."""
    listing = spark.read.schema(f"data struct<children: array<struct<data: struct<{', '.join(x.replace(' ', ': ', 1) for x in _POST.split(', ')) }>>>>").option("multiLine", not lines).json(path)
    posts = listing.select(F.explode("data.children").alias("c")).select("c.data.*").where(_present(F.col("title")).isNotNull())
    url = F.when(_present(F.col("permalink")).isNotNull(), F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))).otherwise(F.col("url"))
    return posts.select("title", url.alias("url"), F.col("selftext").alias("content"), F.timestamp_seconds("created_utc").alias("published_at"), "author", F.regexp_replace("subreddit", "^/?r/", "").alias("source"))


def read_news(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Articles of news responses (a file each, or a line each) whose status is ok; removed and untitled ones are left out; content before description."""
    rows = spark.read.schema(_NEWS).option("multiLine", not lines).json(path).where("status = 'ok'").select(F.explode("articles").alias("a")).select("a.*")
    rows = rows.where(F.col("title").isNotNull() & (F.col("title") != "[Removed]"))
    return rows.select("title", "url", F.coalesce("content", "description").alias("content"), F.try_to_timestamp("publishedAt").alias("published_at"), "author")


def read_article_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, sources) of an exported CSV: trimmed, empty as null, rows without url left out, the first of each url.

    word_count is a number only if it is all digits; sources has the first row of each source_url.
    """
    raw = spark.read.options(**CSV_READ).csv(path)
    rows = raw.select(*[_present(F.col(c)).alias(c) for c in raw.columns]).withColumn("__at", F.monotonically_increasing_id())
    rows = rows.where("url is not null")
    if "word_count" in rows.columns:
        rows = rows.withColumn("word_count", F.when(F.col("word_count").rlike("^[0-9]+$"), F.expr("try_cast(word_count as int)")))
    articles = first_per_key(rows, ["url"], ["__at"])
    sources = first_per_key(rows.where("source_url is not null"), ["source_url"], ["__at"]).select("source_url", "source_name", "source_type")
    return articles.drop("__at"), sources


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a JSON Lines file: lines that are no object, or repeat a key at any depth, are rejected."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def once(pairs):
            keys = [k for k, _ in pairs]
            if len(set(keys)) < len(keys):
                raise ValueError("a key is repeated")
            return dict(pairs)

        for batch in batches:
            reasons = []
            for line in batch.column(0).to_pylist():
                try:
                    reasons.append(None if isinstance(json.loads(line, object_pairs_hook=once), dict) else "not an object")
                except ValueError as error:
                    reasons.append(str(error).split(":")[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string())], names=["line", "reason"])

    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).mapInArrow(check, "line string, reason string")
    records = lines.where("reason is null").select(F.from_json("line", schema).alias("r")).select("r.*")
    return records, lines.where("reason is not null")


def read_statements_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, statement) of a tab-separated file without header in which quotes mean nothing."""
    raw = spark.read.option("sep", "\t").option("quote", "").csv(path)
    return raw.select(F.col("_c0").alias("id"), F.col("_c1").alias("label"), F.col("_c2").alias("statement"))


def read_scored_csv(spark: SparkSession, path: str) -> DataFrame:
    """(text, cfs_score) of a CSV with Text and Verdict: 1.0 for verdict 1, the check-worthy one, else 0.0."""
    raw = _quoted_csv(spark, path)
    return raw.select(F.col("Text").alias("text"), F.coalesce((F.expr("try_cast(Verdict as double)") == 1).cast("double"), F.lit(0.0)).alias("cfs_score"))


def read_claims_csv(spark: SparkSession, path: str) -> DataFrame:
    """(claimID, claim, label) of a CSV, without rows that lack claim or label."""
    return _quoted_csv(spark, path).select("claimID", "claim", "label").na.drop(subset=["claim", "label"])


def read_claim_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, claim, label) of JSON Lines with any further fields; empty lines are skipped, absent fields null."""
    return spark.read.schema("id long, claim string, label string").json(path)


def _quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV_READ).csv(path)


def write_records(records: DataFrame, path: str, key: str) -> DataFrame:
    """Records as JSON Lines with their fields in order of name, sorted by key; an existing path is refused.

    Returns a one-row manifest: count, and a checksum that does not depend on the order of rows.
    """
    ordered = records.select(key, F.to_json(F.struct(*sorted(records.columns))).alias("value"))
    ordered.repartitionByRange(F.col(key)).sortWithinPartitions(key).select("value").write.mode("errorifexists").text(path)
    word = F.conv(F.substring(F.sha2("value", 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return ordered.agg(F.count("*").alias("n"), F.coalesce(F.sum(word), F.lit(0)).cast("string").alias("checksum"))
