"""Spark ML jobs of the domain: topics, text vectors and the logistic method with its calibrator."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StandardScaler, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators.evaluation import best_threshold
from newsloom.plans.staging import stage


def topic_clusters(vectors: DataFrame, k: int, least: int = 5, seed: int = 42) -> DataFrame:
    """(id, topic_id) of vectors (id, v) by k-means; clusters with fewer than `least` members are noise (-1)."""
    rows = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    found = KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select("id", F.col("prediction").alias("topic_id"))
    sizes = found.groupBy("topic_id").agg(F.count("*").alias("n")).withColumnRenamed("topic_id", "t")
    return found.join(F.broadcast(sizes), F.col("topic_id") == F.col("t")).select("id", F.when(F.col("n") >= least, F.col("topic_id")).otherwise(-1).alias("topic_id"))


def topic_words(rows: DataFrame, most: int = 10) -> DataFrame:
    """(topic_id, keywords, label) of rows (topic_id, text): the words that mark each topic, noise (-1) left out.

    A word's weight is its count in the topic times log(1 + mean words per topic / its count in all topics); ties go by
    the alphabet. The label is the topic's number and its first four words.
    """
    words = rows.where("topic_id >= 0").select("topic_id", F.explode(tx.tokens(F.col("text"))).alias("word"))
    counts = stage(words.groupBy("topic_id", "word").agg(F.count("*").alias("n")), "topic-words")
    mean = counts.agg((F.sum("n") / F.count_distinct("topic_id")).alias("mean"))
    total = counts.groupBy("word").agg(F.sum("n").alias("total"))
    weighed = counts.join(total, "word").crossJoin(F.broadcast(mean)).withColumn("weight", F.round(F.col("n") * F.log1p(F.col("mean") / F.col("total")), 9))
    place = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("weight"), "word"))
    best = weighed.withColumn("place", place).where(F.col("place") <= most)
    named = best.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("keywords"))
    return named.withColumn("label", F.concat_ws("_", F.col("topic_id").cast("string"), F.slice("keywords", 1, 4)))


def named_topics(rows: DataFrame, k: int, least: int = 5, most: int = 10) -> DataFrame:
    """(id, topic_id, label, keywords) of rows (id, text, v): `topic_clusters` with the words of each topic.

    Fewer rows than max(3, least) are not clustered: all are noise. Noise has no label and no keywords. Rows without a
    vector are left out.
    """
    rows = rows.where("v is not null")
    if rows.limit(max(3, least)).count() < max(3, least):
        return rows.select("id", F.lit(-1).alias("topic_id"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<string>").alias("keywords"))
    found = stage(topic_clusters(rows.select("id", "v"), k, least), "topics")
    words = topic_words(found.join(rows.select("id", "text"), "id"), most)
    return found.join(F.broadcast(words), "topic_id", "left").select("id", "topic_id", "label", "keywords")


def hashed_vectors(rows: DataFrame, existing: DataFrame, size: int = 256) -> DataFrame:
    """(id, v) for rows (id, text) without a vector in existing (id): hashed words, weighed by rarity, of unit length."""
    missing = rows.join(existing.select("id"), "id", "left_anti").select("id", F.coalesce("text", F.lit("")).alias("text"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=size).transform(Tokenizer(inputCol="text", outputCol="words").transform(missing))
    weighed = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    return Normalizer(inputCol="tfidf", outputCol="unit").transform(weighed).select("id", vector_to_array("unit").alias("v"))


def calibrated_logistic(rows: DataFrame, features: list[str], folds: int = 3, seed: str = "cal") -> DataFrame:
    """(pair_id, split, gold, score): a logistic method fitted and calibrated on the training rows alone.

    rows: pair_id, event_group, split, gold and the features; a missing one counts as 0, with a flag. Training groups are
    dealt into folds by hash, and each fold gets margins from a fit on the others; the calibrator is fitted on those, the
    method anew on all training rows. Dev and test rows are only scored. Raises where a fit would lack a class.
    """
    flags = [F.col(f).isNull().cast("double").alias(f"{f}__missing") for f in features]
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    ready = rows.select("pair_id", "event_group", "split", "gold", F.col("gold").cast("double").alias("label"), *filled, *flags)
    train = stage(ready.where("split = 'train'").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "event_group"), F.lit(folds))), "training-pairs")
    held = {(r["part"], r["gold"]) for r in train.select("part", "gold").distinct().collect()}
    parts = sorted({part for part, _ in held})
    if any(len({gold for part, gold in held if part != own}) < 2 for own in parts) or len(parts) < 2:
        raise ValueError("the training groups cannot support calibration: a fit would lack a class")
    assembler = VectorAssembler(inputCols=features + [f"{f}__missing" for f in features], outputCol="raw")
    method = Pipeline(stages=[assembler, StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=50, regParam=0.01)])
    margin = lambda fitted, df: fitted.transform(df).select("pair_id", "split", "gold", "label", vector_to_array("rawPrediction")[1].alias("margin"))
    outside = None
    for part in parts:
        scored = margin(method.fit(train.where(F.col("part") != part)), train.where(F.col("part") == part))
        outside = scored if outside is None else outside.union(scored)
    line = VectorAssembler(inputCols=["margin"], outputCol="features")
    calibrator = LogisticRegression(maxIter=50).fit(line.transform(outside))
    scored = calibrator.transform(line.transform(margin(method.fit(train), ready)))
    return scored.select("pair_id", "split", "gold", vector_to_array("probability")[1].alias("score"))


def logistic_ablations(rows: DataFrame, features: list[str]) -> DataFrame:
    """(method, pair_id, split, gold, score, threshold, predicted): the method on all features and without each one.

    A method's threshold is that of the best F1 on its dev rows, of equal ones the highest; test rows choose nothing.
    """
    kept = {"all": features} | {f"without_{f}": [g for g in features if g != f] for f in features if len(features) > 1}
    out = None
    for name, names in kept.items():
        scored = stage(calibrated_logistic(rows, names).withColumn("score", F.round("score", 6)), "scored-pairs")
        chosen = best_threshold(scored.where("split = 'dev'").select(F.col("score").alias("sim_score"), "gold")).select("threshold")
        part = scored.crossJoin(F.broadcast(chosen)).withColumns({"method": F.lit(name), "predicted": F.col("score") >= F.col("threshold")})
        out = part if out is None else out.unionByName(part)
    return out.select("method", "pair_id", "split", "gold", "score", "threshold", "predicted")
