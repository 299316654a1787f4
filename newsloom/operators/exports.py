"""Exports: vertices and edges of several labels in one table, with a folder for each label; predictions as CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import csv_safe
from newsloom.plans.staging import new_folder


def _rows(df: DataFrame, label: str, key: Column, other: Column | None = None) -> DataFrame:
    return df.select(F.lit(label).alias("label"), key.cast("string").alias("key"), (F.lit(None) if other is None else other).cast("string").alias("other")).where("key is not null")


def claim_graph(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(label, key, other): Source, Claim and Entity vertices (type and text), PUBLISHED_BY and MENTIONS edges, each once."""
    entity = F.concat_ws(":", "entity_type", "entity_text")
    parts = [
        _rows(claims, "Source", F.col("domain")),
        _rows(claims, "Claim", F.col("claim_id")),
        _rows(entities, "Entity", entity),
        _rows(claims, "PUBLISHED_BY", F.col("claim_id"), F.col("domain")).where("other is not null"),
        _rows(entities, "MENTIONS", F.col("claim_id"), entity),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def article_graph(articles: DataFrame, similar: DataFrame, duplicates: DataFrame, title: int = 300) -> DataFrame:
    """(label, key, other): Article (with its title, cut) and Domain vertices, FROM_DOMAIN, SIMILAR and DUPLICATE_OF edges.

    similar and duplicates: (a, b); a duplicate b points to the first copy a. Articles without a domain get no edge.
    """
    parts = [
        _rows(articles, "Article", F.col("article_id"), F.substring("title", 1, title)),
        _rows(articles, "Domain", F.col("domain")),
        _rows(articles, "FROM_DOMAIN", F.col("article_id"), F.col("domain")).where("other is not null"),
        _rows(similar, "SIMILAR", F.col("a"), F.col("b")),
        _rows(duplicates, "DUPLICATE_OF", F.col("b"), F.col("a")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def write_labelled(rows: DataFrame, by: str, path: str | None = None) -> DataFrame:
    """Write rows as Parquet with a folder for each value of `by`, and read them back."""
    spark = rows.sparkSession
    path = path or new_folder(spark, "export")
    rows.write.partitionBy(by).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def write_predictions(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Write rows as CSV files with headers, cells that a spreadsheet would take for formulas marked, and read them back.

    Quotes are doubled; line ends and blanks at either end are kept; empty cells come back as nulls.
    """
    spark = rows.sparkSession
    path = path or new_folder(spark, "predictions")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    safe = [csv_safe(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes]
    rows.select(*safe).write.options(**options).csv(path)
    return spark.read.schema(rows.schema).options(multiLine=True, **options).csv(path)
