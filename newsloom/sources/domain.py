"""The news domain's tables, derived from the given Parquet tables.

Times are whole seconds since 1970. Articles are documents with the time of the event of the same id; claims are their
first sentences; bands, relations and votes follow from the ids by fixed rules, so that SQL can derive them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as tx

_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at_s", F.expr(_SECONDS)).drop("ts")


def draw(key: Column) -> Column:
    """0 to 999 from an id."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 1000


def _with_time(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows (article_id, ...) with at_s, the time of the event of the same id. Everything that follows from a text is
    made before this join, so that only what a query reads of it is shuffled."""
    times = events(spark, sf_dir).select("event_id", "at_s")
    return rows.join(times, rows["article_id"] == times["event_id"], "left")


def untimed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from the documents alone; their texts stay where they are."""
    status = F.expr("case doc_id % 10 when 0 then 'raw' when 1 then 'processing' when 2 then 'failed' else 'processed' end")
    title = F.substring("text", 1, 80)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.concat("source", F.lit(".example")).alias("domain"),
        title.alias("title"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example/a/"), (F.col("doc_id") - F.col("doc_id") % 20).cast("string")).alias("url"),
        F.concat(F.lit("author"), (F.col("doc_id") % 7).cast("string")).alias("author"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        status.alias("status"),
        tx.content_hash(title, F.col("text")).alias("content_hash"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.when(F.col("article_id") % 17 != 0, F.col("at_s")).alias("published_s")
    rows = _with_time(untimed_articles(spark, sf_dir), spark, sf_dir)
    return rows.select("article_id", "domain", "title", "url", "author", "content", "language", published, (F.col("at_s") + 3600).alias("collected_s"), "status", "content_hash")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("article_id"), F.concat("source", F.lit(".example")).alias("domain"), F.posexplode(tx.sentences(F.col("text"))).alias("pos", "claim_text"))
    claim = found.withColumn("claim_id", F.col("article_id") * 8 + F.col("pos"))
    p = draw(F.col("claim_id")) / 1000.0
    band = tx.verdict_band(p, F.col("claim_id") % 13 == 0, F.col("claim_id") % 3 > 0)
    scored = F.col("claim_id") % 11 != 0
    made = claim.select(
        "claim_id",
        "article_id",
        "domain",
        "claim_text",
        tx.claim_worthiness(F.col("claim_text")).alias("confidence"),
        "pos",
        (F.col("article_id") % 12 - 1).cast("int").alias("topic_id"),
        F.when(scored, p).alias("probability"),
        F.when(scored, band).alias("verdict"),
    )
    published = F.when(F.col("article_id") % 17 != 0, F.col("at_s")).alias("published_s")
    extracted = (F.col("at_s") + 3600 + F.col("pos") * 60).alias("extracted_s")
    return _with_time(made, spark, sf_dir).select("claim_id", "article_id", "domain", "claim_text", "confidence", published, extracted, "topic_id", "probability", "verdict")


def relations(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """from_id (child), to_id (parent), kind, score, created_s between claims that exist; of: the claims, if at hand."""
    base = (claims(spark, sf_dir) if of is None else of).select("claim_id", "extracted_s")
    parent = F.when(F.col("claim_id") % 4 == 1, F.col("claim_id") - 1).when(F.col("claim_id") % 4 == 2, F.floor(F.col("claim_id") / 16) * 8)
    pairs = base.select(F.col("claim_id").alias("from_id"), parent.alias("to_id"), F.col("extracted_s").alias("created_s")).where("to_id is not null and to_id <> from_id")
    kept = pairs.join(base.select(F.col("claim_id").alias("to_id")), "to_id", "left_semi")
    kind = F.when(F.col("from_id") % 8 < 4, "EVOLVED_FROM").otherwise("SIMILAR_TO")
    return kept.select("from_id", "to_id", kind.alias("kind"), (draw(F.col("from_id") * 31 + 7) / 1000.0).alias("score"), "created_s")


def article_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected similarity edges a < b between articles, with a score."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    pairs = ids.where("doc_id % 3 <> 0").select(F.floor(F.col("doc_id") / 2).alias("a"), F.col("doc_id").alias("b"))
    pairs = pairs.union(ids.where("doc_id % 5 = 0 and doc_id >= 3").select((F.col("doc_id") - 3).alias("a"), F.col("doc_id").alias("b")))
    pairs = pairs.where("a < b").distinct()
    return pairs.select("a", "b", (draw(F.col("a") * 1000003 + F.col("b")) / 1000.0).alias("score"))


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, event_group, split, sim_score, gold (0 or 1) from the table of labels."""
    split = F.expr("case (doc_id div 8) % 3 when 0 then 'train' when 1 then 'dev' else 'test' end")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (draw(F.col("doc_id")) + F.col("quality") * 300) / 1300.0))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair_id"), F.expr("doc_id div 8").alias("event_group"), split.alias("split"), score.alias("sim_score"), F.col("quality").cast("int").alias("gold"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, annotator, origin, label, voted_s: three voters with fixed rules; not everyone votes on every pair."""
    pairs = eval_pairs(spark, sf_dir).select("pair_id", "gold")
    voter = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    seen = pairs.select("pair_id", "gold", voter.alias("who")).withColumn("d", draw(F.col("pair_id") * 10 + F.col("who"))).where("d >= 150")
    label = F.expr("case when d < 350 then 'EVOLVED' when (gold = 1) = (d < 900) then 'SAME_STORY' else 'DISTINCT' end")
    origin = F.expr("case when who = 3 then 'WEAK' else 'HUMAN' end")
    return seen.select("pair_id", F.concat(F.lit("user:"), F.col("who").cast("string")).alias("annotator"), origin.alias("origin"), label.alias("label"), (F.col("d") * 60 + F.col("who")).alias("voted_s"))


#: The same tables in DuckDB SQL, as common table expressions.
VIEWS_SQL = r"""
ev AS (SELECT event_id, user_id, event_type, value, props, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events),
articles AS (
  SELECT d.doc_id AS article_id, d.source || '.example' AS domain, substr(d.text, 1, 80) AS title,
    'https://www.' || d.source || '.example/a/' || (d.doc_id - d.doc_id % 20) AS url, 'author' || (d.doc_id % 7) AS author,
    d.text AS content, d.lang AS language, CASE WHEN d.doc_id % 17 <> 0 THEN e.at_s END AS published_s, e.at_s + 3600 AS collected_s,
    CASE d.doc_id % 10 WHEN 0 THEN 'raw' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'processed' END AS status,
    sha256(lower(trim(substr(d.text, 1, 80))) || ':' || lower(trim(d.text))) AS content_hash
  FROM documents d LEFT JOIN ev e ON e.event_id = d.doc_id),
sentence AS (
  SELECT article_id, domain, published_s, collected_s, list_filter(list_transform(string_split(regexp_replace(trim(content), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 30 AND length(x) < 400)[1:8] AS s FROM articles),
claim0 AS (SELECT article_id, domain, published_s, collected_s, unnest(s) AS claim_text, unnest(range(len(s))) AS pos FROM sentence),
claim1 AS (SELECT *, article_id * 8 + pos AS claim_id FROM claim0),
claim2 AS (SELECT *, (('0x' || substr(md5(CAST(claim_id AS VARCHAR)), 1, 8))::UBIGINT % 1000) / 1000.0::DOUBLE AS p FROM claim1),
claims AS (
  SELECT claim_id, article_id, domain, claim_text,
    least(97, greatest(5, 50 + CASE WHEN regexp_matches(claim_text, '[0-9]') THEN 15 ELSE 0 END
      + CASE WHEN regexp_matches(lower(claim_text), 'said|according to|announced|reported|confirmed|stated') THEN 12 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(claim_text, '\S+')) >= 10 THEN 8 ELSE 0 END
      - CASE WHEN regexp_matches(' ' || lower(claim_text) || ' ', ' i | my | we | our |think|feel|love|hate|ridiculous') THEN 30 ELSE 0 END)) / 100.0::DOUBLE AS confidence,
    published_s, collected_s + pos * 60 AS extracted_s, CAST(article_id % 12 - 1 AS INTEGER) AS topic_id,
    CASE WHEN claim_id % 11 <> 0 THEN p END AS probability,
    CASE WHEN claim_id % 11 <> 0 THEN CASE WHEN claim_id % 13 = 0 THEN CASE WHEN p < 0.45 THEN 'DISPUTED' ELSE 'UNRESOLVED' END
      WHEN NOT claim_id % 3 > 0 THEN CASE WHEN p >= 0.38 THEN 'UNRESOLVED' ELSE 'UNSUPPORTED' END
      WHEN p >= 0.72 THEN 'SUPPORTED' WHEN p >= 0.55 THEN 'PARTIALLY_SUPPORTED' WHEN p >= 0.38 THEN 'UNRESOLVED' ELSE 'WEAKLY_CORROBORATED' END END AS verdict
  FROM claim2),
relation0 AS (SELECT claim_id AS from_id, CASE WHEN claim_id % 4 = 1 THEN claim_id - 1 WHEN claim_id % 4 = 2 THEN (claim_id // 16) * 8 END AS to_id, extracted_s AS created_s FROM claims),
relations AS (
  SELECT from_id, to_id, CASE WHEN from_id % 8 < 4 THEN 'EVOLVED_FROM' ELSE 'SIMILAR_TO' END AS kind,
    (('0x' || substr(md5(CAST(from_id * 31 + 7 AS VARCHAR)), 1, 8))::UBIGINT % 1000) / 1000.0::DOUBLE AS score, created_s
  FROM relation0 WHERE to_id IS NOT NULL AND to_id <> from_id AND to_id IN (SELECT claim_id FROM claims)),
edge0 AS (SELECT doc_id // 2 AS a, doc_id AS b FROM documents WHERE doc_id % 3 <> 0 UNION SELECT doc_id - 3, doc_id FROM documents WHERE doc_id % 5 = 0 AND doc_id >= 3),
article_edges AS (SELECT a, b, (('0x' || substr(md5(CAST(a * 1000003 + b AS VARCHAR)), 1, 8))::UBIGINT % 1000) / 1000.0::DOUBLE AS score FROM edge0 WHERE a < b),
eval_pairs AS (
  SELECT doc_id AS pair_id, doc_id // 8 AS event_group, CASE (doc_id // 8) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT % 1000 AS BIGINT) + quality * 300) / 1300.0::DOUBLE)) AS sim_score,
    CAST(quality AS INTEGER) AS gold FROM labels),
vote0 AS (SELECT pair_id, gold, who, CAST(('0x' || substr(md5(CAST(pair_id * 10 + who AS VARCHAR)), 1, 8))::UBIGINT % 1000 AS BIGINT) AS d FROM eval_pairs, (VALUES (1), (2), (3)) v(who)),
votes AS (
  SELECT pair_id, 'user:' || who AS annotator, CASE WHEN who = 3 THEN 'WEAK' ELSE 'HUMAN' END AS origin,
    CASE WHEN d < 350 THEN 'EVOLVED' WHEN (gold = 1) = (d < 900) THEN 'SAME_STORY' ELSE 'DISTINCT' END AS label, d * 60 + who AS voted_s
  FROM vote0 WHERE d >= 150)
"""
