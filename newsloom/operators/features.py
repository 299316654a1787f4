"""Sparse text vectors as tables."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from newsloom.functions import text as tx
from newsloom.functions.spans import SPARK_ENTITY_KINDS


#: White space as Python's str.split() sees it.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def ngram_tfidf(rows: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """(id, term, w): unit vectors of character n-grams over (id, text); w = (1 + ln tf)(ln((1 + n) / (1 + df)) + 1).

    N-grams lie inside words with one blank on either side; a padded word shorter than `low` counts once as a whole.
    """
    words = F.filter(F.split(F.lower("text"), SPACE), lambda w: w != "")
    padded = rows.select("id", F.explode(words).alias("t")).select("id", F.concat(F.lit(" "), "t", F.lit(" ")).alias("t"))
    grams = padded.where(F.length("t") < low).select("id", F.col("t").alias("term"))
    for n in range(low, high + 1):
        grams = grams.union(padded.where(F.length("t") >= n).select("id", F.explode(_grams(n)).alias("term")))
    tf = grams.groupBy("id", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = rows.agg(F.count_distinct("id").alias("total"))
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def pair_cosine(low: int = 3, high: int = 5):
    """A column function of two lower-cased texts: their cosine by ngram_tfidf fitted on these two alone, 0 without terms.

    A term's document frequency is then 1 or 2, so a pair needs nothing beyond its row, and nothing is shuffled.
    """

    @pandas_udf(DoubleType())
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_two_texts(_counts(x, low, high), _counts(y, low, high)) for x, y in zip(a, b)], dtype="float64")

    return cosine


def _counts(text: str | None, low: int, high: int) -> Counter[str]:
    found: Counter[str] = Counter()
    for word in (text or "").split():
        padded = f" {word} "
        for n in range(low, high + 1):
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return found


def _two_texts(x: Counter[str], y: Counter[str]) -> float:
    alone = math.log(1.5) + 1
    shared = x.keys() & y.keys()
    uv = sum((1 + math.log(x[t])) * (1 + math.log(y[t])) for t in shared)
    uu, vv = (sum(((1 + math.log(n)) * (1.0 if t in shared else alone)) ** 2 for t, n in c.items()) for c in (x, y))
    return uv / math.sqrt(uu * vv) if uu and vv else 0.0


def pair_tfidf_cosine(pairs: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """(pair, cosine) of the two texts of each pair (pair, a, b)."""
    return pairs.select("pair", pair_cosine(low, high)(F.lower("a"), F.lower("b")).alias("cosine"))


def _grams(n: int):
    return F.transform(F.sequence(F.lit(1), F.length("t") - (n - 1)), lambda i: F.substr(F.col("t"), i, F.lit(n)))


def sparse_cosine(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score) for given pairs of ids that share a term."""
    left = weights.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"))
    right = weights.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def entity_set(text: Column, longest: int = 500) -> Column:
    """Distinct lower-cased entities of a text's beginning: money, shares, years, names and capitalised tokens."""
    head = F.substring(text, 1, longest)
    found = [F.regexp_extract_all(head, F.lit(p), F.lit(0)) for p in SPARK_ENTITY_KINDS.values()]
    return F.array_distinct(F.filter(F.transform(F.concat(*found, tx.entity_tokens(head)), lambda t: F.lower(t)), lambda t: F.length(t) > 1))


def entity_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two entity sets, and .1 for each pair of which one holds the other (three at most); null if
    either is empty."""
    partial = F.aggregate(a, F.lit(0), lambda n, x: n + F.size(F.filter(b, lambda y: (y != x) & (F.contains(y, x) | F.contains(x, y)))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), tx.jaccard(a, b) + 0.1 * F.least(partial, F.lit(3)))
