"""Filters, point-in-time selection and pages of ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def list_articles(articles: DataFrame, query: str | None = None, domain: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Processed articles, newest first (undated last), with a case-blind search in title or author and an excerpt."""
    rows = articles.where("status = 'processed'")
    if query:
        rows = rows.where(F.col("title").ilike(f"%{query}%") | F.col("author").ilike(f"%{query}%"))
    if domain:
        rows = rows.where(F.col("domain") == domain)
    page = rows.orderBy(F.col("published_s").desc_nulls_last(), "article_id").offset(offset).limit(limit)
    return page.select("article_id", "title", "domain", "published_s", F.left(F.coalesce("content", F.lit("")), F.lit(240)).alias("excerpt"))


def newest(rows: DataFrame, time: Column, key: str, limit: int) -> DataFrame:
    return rows.orderBy(time.desc_nulls_last(), key).limit(limit)


def list_verdicts(claims: DataFrame, band: str | None = None, domain: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Scored claims, least probable first, each with the total of all that match; an empty page keeps the total."""
    rows = claims.where("verdict is not null")
    if band:
        rows = rows.where(F.col("verdict") == band)
    if domain:
        rows = rows.where(F.col("domain") == domain)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.col("probability").asc_nulls_last(), "claim_id").offset(offset).limit(limit)
    return total.join(page.select("claim_id", "probability", "verdict", "domain"), F.lit(True), "left")


def eligible_at(claims: DataFrame, cutoff: int, historical: bool) -> DataFrame:
    """Claims known at a cutoff: extracted, collected and published by then; undated ones only when not historical."""
    published = F.col("published_s") <= cutoff
    return claims.where((F.col("extracted_s") <= cutoff) & (F.col("collected_s") <= cutoff) & (published if historical else published | F.col("published_s").isNull()))


def valid_vectors(vectors: DataFrame, by: str = "label") -> DataFrame:
    """Vectors that are finite, not zero, and as long as the first (smallest id) valid one of their group."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(by).agg(F.min_by(F.size("embedding"), "vec_id").alias("__size")).withColumnRenamed(by, "__by")
    return rows.join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.size("embedding") == F.col("__size"))).drop("__by", "__size")


def seeded_sample(rows: DataFrame, key: str, seed: str, limit: int) -> DataFrame:
    """The first `limit` rows by the digest of key and seed: the same rows on every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(limit)


def unscored(claims: DataFrame, limit: int, rescore: bool = False) -> DataFrame:
    rows = claims if rescore else claims.where("verdict is null")
    return rows.orderBy(F.col("confidence").desc_nulls_last(), "claim_id").limit(limit)


def newest_with_flag(articles: DataFrame, most: int) -> DataFrame:
    """The newest `most` rows and whether there were more: one more row is read than is kept."""
    read = articles.orderBy(F.col("published_s").desc_nulls_last(), "article_id").limit(most + 1)
    numbered = read.withColumn("rn", F.row_number().over(W.orderBy(F.col("published_s").desc_nulls_last(), "article_id")))
    return numbered.withColumn("truncated", F.count("*").over(W.partitionBy()) > most).where(F.col("rn") <= most).drop("rn")
