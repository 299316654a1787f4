"""Upserts, pruning and unions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ranking import first_per_key


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str, order: list) -> DataFrame:
    """The incoming rows that are new by key, the first of each."""
    return first_per_key(incoming.where(F.col(key).isNotNull()), [key], order).join(existing.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], refreshed: list[str], kept: list[str] | None = None) -> DataFrame:
    """Rows of either table by key; `refreshed` columns take the new value where there is one, `kept` ones the old."""
    kept = kept or []
    right = new.select(*[F.col(c).alias(f"__{c}") for c in [*keys, *refreshed, *kept]])
    same = [old[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    joined = old.join(right, same, "full")
    pick = {k: F.coalesce(k, f"__{k}") for k in keys} | {c: F.coalesce(f"__{c}", c) for c in refreshed} | {c: F.coalesce(c, f"__{c}") for c in kept}
    return joined.select(*[v.alias(c) for c, v in pick.items()])


def prune_stale_parents(edges: DataFrame, evaluated: DataFrame, current: DataFrame) -> DataFrame:
    """Edges without those EVOLVED_FROM ones of evaluated children that are no longer current; others stay."""
    subject = (F.col("kind") == "EVOLVED_FROM")
    checked = edges.where(subject).join(evaluated.select("from_id"), "from_id", "left_semi")
    stale = checked.join(current.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").select("from_id", "to_id", "kind")
    return edges.join(stale, ["from_id", "to_id", "kind"], "left_anti")


def undirected_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """One edge per unordered pair: those of `first` with their best score, then `second`'s with score 1."""
    side = lambda e, rank, score: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("score"), F.lit(rank).alias("rank"))
    rows = side(first, 0, F.col("score")).union(side(second, 1, F.lit(1.0)))
    kept = first_per_key(rows.where("a < b"), ["a", "b"], [F.col("rank"), F.desc("score")])
    return kept.select("a", "b", F.round("score", 3).alias("score"), F.when(F.col("rank") == 0, "SIMILAR").otherwise("DUPLICATE_OF").alias("kind"))


def duplicate_stars(articles: DataFrame) -> DataFrame:
    """Exact duplicates as a star: the first article of each hash to every other."""
    hubs = articles.groupBy("content_hash").agg(F.min("article_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("content_hash", "a")
    return articles.select("content_hash", F.col("article_id").alias("b")).join(hubs, "content_hash").where("b > a").select("a", "b")
