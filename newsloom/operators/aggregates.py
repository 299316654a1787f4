"""Counts, distributions and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx

SUPPORTED, DISPUTED = ("SUPPORTED", "PARTIALLY_SUPPORTED"), ("DISPUTED",)


def facet(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def corpus_stats(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    embedded = vectors.where("embedding is not null").select(F.col("vec_id").alias("article_id"))
    flagged = articles.join(embedded.withColumn("has", F.lit(1)), "article_id", "left")
    return flagged.agg(F.count("*").alias("articles"), F.count("has").alias("embedded"), F.count_distinct("domain").alias("domains"), F.min("published_s").alias("first_s"), F.max("published_s").alias("last_s"))


def zero_filled(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Counts for every value of a fixed domain, 0 where there are no rows."""
    domain = rows.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return F.broadcast(domain).join(facet(rows, by), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def verdict_distribution(claims: DataFrame) -> DataFrame:
    band = F.coalesce("verdict", F.lit("UNSCORED")).alias("band")
    return claims.groupBy(band).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("avg_probability"))


def outlet_credibility(claims: DataFrame) -> DataFrame:
    """Per outlet: scored claims, supported and disputed ones, and (s + 2) / (s + d + 4)."""
    supported, disputed = F.count_if(F.col("verdict").isin(*SUPPORTED)), F.count_if(F.col("verdict").isin(*DISPUTED))
    rows = claims.where("verdict is not null").groupBy("domain").agg(F.count("*").alias("claims"), supported.alias("supported"), disputed.alias("disputed"))
    return rows.withColumn("credibility", F.round((F.col("supported") + 2) / (F.col("supported") + F.col("disputed") + 4), 6))


def feedback_tally(feedback: DataFrame) -> DataFrame:
    """Per band: agreeing and disagreeing votes and the agreement rate."""
    rows = feedback.groupBy("band").agg(F.count_if(F.col("vote") == "AGREE").alias("agree"), F.count_if(F.col("vote") == "DISAGREE").alias("disagree"))
    return rows.withColumn("rate", F.round(F.col("agree") / (F.col("agree") + F.col("disagree")), 4))


def topic_claims(claims: DataFrame) -> DataFrame:
    """(topic_id, n, claim_id): each topic's size beside each of its claims; noise (-1) left out. No row holds a topic."""
    rows = claims.where("topic_id >= 0").select("topic_id", "claim_id")
    return rows.join(rows.groupBy("topic_id").agg(F.count("*").alias("n")), "topic_id").select("topic_id", "n", "claim_id")


def outlet_neighbours(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Per outlet: its articles, and the distinct articles of other outlets that an edge joins to them."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    own = articles.select("article_id", "domain")
    other = articles.select(F.col("article_id").alias("b"), F.col("domain").alias("other"))
    met = own.join(both, own["article_id"] == both["a"], "left").join(other, "b", "left")
    return met.groupBy("domain").agg(F.count_distinct("article_id").alias("stories"), F.count_distinct(F.when(F.col("other") != F.col("domain"), F.col("b"))).alias("neighbours"))


def bursts(claims: DataFrame, since: int, least: int) -> DataFrame:
    """Topics with at least `least` claims since a time."""
    return claims.where((F.col("extracted_s") >= since) & (F.col("topic_id") >= 0)).groupBy("topic_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cluster_dossier(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Per outlet cluster: size, first and last time, span, least and greatest edge score."""
    times = articles.groupBy("domain").agg(F.count("*").alias("size"), F.min("published_s").alias("first_s"), F.max("published_s").alias("last_s"))
    inside = edges.join(articles.select(F.col("article_id").alias("a"), "domain"), "a").groupBy("domain").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    return times.join(inside, "domain", "left").withColumn("span_s", F.col("last_s") - F.col("first_s"))


def vote_provenance(votes: DataFrame, origins: list[str]) -> DataFrame:
    seen = votes.groupBy("origin").agg(F.count("*").alias("votes"), F.count_distinct("pair_id").alias("pairs"))
    domain = votes.sparkSession.createDataFrame([(o,) for o in origins], "origin string")
    return F.broadcast(domain).join(seen, "origin", "left").select("origin", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def coverage(pairs: DataFrame, votes: DataFrame, by: str) -> DataFrame:
    """Per bucket or split: pairs, and those with at least one vote."""
    seen = votes.select("pair_id").distinct().withColumn("voted", F.lit(1))
    return pairs.join(seen, "pair_id", "left").groupBy(by).agg(F.count("*").alias("pairs"), F.count("voted").alias("labelled"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A checksum of a set of rows that does not depend on their order: count and the sum of row digests."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("checksum"))


def collection_summary(fetched: DataFrame, failures: DataFrame) -> DataFrame:
    """(source, fetched, inserted, error) for fetched (source, url, id) and failures (source, error).

    Of rows with one url the lowest id is inserted; rows without a url never are. A source that failed has its rows taken
    back: it counts nothing, keeps no url from others, and its first error is shown in one line.
    """
    failed = failures.groupBy("source").agg(F.concat(F.lit("Failed - "), tx.one_line(F.min("error"))).alias("error"))
    kept = fetched.join(failed.select("source"), "source", "left_anti")
    first = kept.where("url is not null").groupBy("url").agg(F.min_by("source", "id").alias("source"))
    inserted = first.groupBy("source").agg(F.count("*").alias("inserted"))
    counts = kept.groupBy("source").agg(F.count("*").alias("fetched")).join(inserted, "source", "left")
    done = counts.select("source", "fetched", F.coalesce("inserted", F.lit(0)).alias("inserted"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(failed.select("source", F.lit(0).cast("long").alias("fetched"), F.lit(0).cast("long").alias("inserted"), "error"))
