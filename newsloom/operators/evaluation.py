"""Metrics over scored and labelled pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ranking import average_ranks, running_confusion
from newsloom.plans.staging import attach, running_totals, stage


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return F.when(b != 0, a / b)


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def binary_metrics(rows: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of score >= threshold, null on zero division."""
    hit = F.col("sim_score") >= threshold
    count = lambda c: F.count_if(c)
    table = rows.groupBy(*(by or [])).agg(count(hit & (F.col("gold") == 1)).alias("tp"), count(hit & (F.col("gold") == 0)).alias("fp"), count(~hit & (F.col("gold") == 1)).alias("fn"))
    return table.select(*(by or []), "tp", "fp", "fn", *[F.round(c, 6).alias(n) for c, n in zip(_prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"))])


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve from average ranks; .5 when a class is missing."""
    sums = average_ranks(rows, "sim_score").agg(F.sum(F.when(F.col("gold") == 1, F.col("avg_rank"))).alias("r"), F.count_if(F.col("gold") == 1).alias("p"), F.count_if(F.col("gold") == 0).alias("n"))
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))
    return sums.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), area).otherwise(F.lit(0.5)), 6).alias("auroc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall over descending distinct scores."""
    curve = running_confusion(rows)
    total = rows.agg(F.sum("gold").alias("positives"))
    return curve.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("tp") / (F.col("tp") + F.col("fp")) * F.col("step") / F.col("positives")), 6).alias("average_precision"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The threshold of the best F1 over all scores; of equal ones the highest."""
    total = rows.agg(F.sum("gold").alias("positives"))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    scored = running_confusion(rows).crossJoin(F.broadcast(total)).withColumn("f1", F.round(f1, 9))
    best = scored.agg(F.max(F.struct("f1", "sim_score")).alias("x"))
    return best.select(F.round("x.f1", 6).alias("f1"), F.round("x.sim_score", 6).alias("threshold"))


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """binary_metrics at each of a few thresholds, in one pass over the rows."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    crossed = rows.select("sim_score", "gold", levels.alias("threshold"))
    hit = F.col("sim_score") >= F.col("threshold")
    table = crossed.groupBy("threshold").agg(F.count_if(hit & (F.col("gold") == 1)).alias("tp"), F.count_if(hit & (F.col("gold") == 0)).alias("fp"), F.count_if(~hit & (F.col("gold") == 1)).alias("fn"))
    return table.select("threshold", *[F.round(c, 6).alias(n) for c, n in zip(_prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"))])


def cohen_kappa(votes: DataFrame) -> DataFrame:
    """Agreement of each pair of annotators over the pairs both voted on; 1 when chance agreement is 1."""
    v = votes.select("pair_id", "annotator", "label").distinct()
    w = v.select("pair_id", F.col("annotator").alias("other"), F.col("label").alias("other_label"))
    cells = v.join(w, "pair_id").where("annotator < other").groupBy("annotator", "other", "label", "other_label").agg(F.count("*").alias("n"))
    key = ["annotator", "other"]
    rows = cells.groupBy(*key, "label").agg(F.sum("n").alias("x"))
    cols = cells.groupBy(*key, F.col("other_label").alias("label")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, [*key, "label"]).groupBy(*key).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    total = cells.groupBy(*key).agg(F.sum("n").alias("items"), F.sum(F.when(F.col("label") == F.col("other_label"), F.col("n")).otherwise(0)).alias("same"))
    joined = total.join(chance, key, "left").withColumn("pe", F.coalesce(F.col("xy"), F.lit(0)) / (F.col("items") * F.col("items")))
    po = F.col("same") / F.col("items")
    return joined.select(*key, "items", F.round(F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((po - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg(F.pow(F.col("sim_score") - F.col("gold"), 2)), 6).alias("brier"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin (lo, hi], 0 in the first: rows, mean score, share of positives; empty bins are left out."""
    low = F.lit(0)
    for k in range(1, bins):
        low = F.when(F.col("sim_score") > k / bins, k).otherwise(low)
    return rows.groupBy(low.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("sim_score"), 6).alias("mean_score"), F.round(F.avg("gold"), 6).alias("positive_rate"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    table = reliability(rows, bins)
    return table.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_rate"))) / F.sum("n"), 5).alias("ece"))


#: A published rational fit of erfc, off by 1.2e-7 of its value at most.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function for x from 0 on."""
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        fit = c + t * fit
    return t * F.exp(fit - x * x)


def mcnemar(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """Discordant counts of two decisions against gold, the statistic with continuity correction, and its p."""
    a, b = first == (F.col("gold") == 1), second == (F.col("gold") == 1)
    n = rows.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    stat = F.when(F.col("b") + F.col("c") > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / (F.col("b") + F.col("c"))).otherwise(0.0)
    n = n.withColumn("raw", stat)
    p = F.when(F.col("raw") > 0, F.round(erfc(F.sqrt(F.col("raw") / 2)), 6)).otherwise(1.0)
    return n.select("b", "c", F.round("raw", 4).alias("statistic"), p.alias("p_value"))


def human_consensus(votes: DataFrame, least: int = 2) -> DataFrame:
    """Pairs on which at least so many people voted, all alike."""
    people = votes.where("origin = 'HUMAN'").groupBy("pair_id").agg(F.count_distinct("annotator").alias("voters"), F.min("label").alias("label"), F.max("label").alias("other"))
    return people.where((F.col("voters") >= least) & (F.col("label") == F.col("other"))).select("pair_id", "voters", "label")


def typed_consensus(votes: DataFrame, least: int = 2) -> DataFrame:
    """(pair_id, voters, status, label, mutation_status, mutation_types) of pairs with human votes.

    votes: (pair_id, annotator, origin, label, mutation_types), types being an array, or null where none were given. Types
    count as sets, and only where the label is agreed: all given and equal, given in part, or in conflict.
    """
    key = F.array_join(F.array_sort(F.array_distinct("mutation_types")), ",")
    people = votes.where("origin = 'HUMAN'").groupBy("pair_id").agg(
        F.count_distinct("annotator").alias("voters"), F.count_distinct("label").alias("labels"), F.min("label").alias("label"),
        F.count("*").alias("n"), F.count(key).alias("known"), F.count_distinct(key).alias("kinds"), F.min(key).alias("types"),
    )
    status = F.when(F.col("labels") > 1, "disagreement").when(F.col("voters") >= least, "agreed").otherwise("needs_human_votes")
    agreed = F.col("status") == "agreed"
    typed = F.when(~agreed | (F.col("known") == 0), "not_annotated").when(F.col("kinds") > 1, "disagreement").when(F.col("known") < F.col("n"), "incomplete").otherwise("agreed")
    rows = people.withColumn("status", status).withColumn("mutation_status", typed)
    return rows.select("pair_id", "voters", "status", F.when(agreed, F.col("label")).alias("label"), "mutation_status", F.when(F.col("mutation_status") == "agreed", F.col("types")).alias("mutation_types"))


def weak_majority(votes: DataFrame) -> DataFrame:
    """Per pair and origin the label with most votes; ties are dropped."""
    counts = votes.groupBy("pair_id", "origin", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("pair_id", "origin").agg(F.max("n").alias("top"))
    won = counts.join(best, ["pair_id", "origin"]).where("n = top").groupBy("pair_id", "origin").agg(F.count("*").alias("winners"), F.min("label").alias("label"))
    return won.where("winners = 1").select("pair_id", "origin", "label")


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per class: true and false positives, false negatives, precision, recall and F1 (0 on zero division)."""
    long = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), (F.col(gold) == F.col(predicted)).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col(gold) != F.col(predicted)).cast("int").alias("fn")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("tp"), (F.col(gold) != F.col(predicted)).cast("int").alias("fp"), F.lit(0).alias("fn")))).alias("x"))
    table = long.groupBy("x.label").agg(F.sum("x.tp").alias("tp"), F.sum("x.fp").alias("fp"), F.sum("x.fn").alias("fn"))
    return table.select("label", "tp", "fp", "fn", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for c, n in zip(_prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"))])


def bootstrap_mean(rows: DataFrame, value: str, key: str, resamples: int, seed: str) -> DataFrame:
    """Percentile interval (2.5 to 97.5) of the mean over resamples drawn by digests of seed, resample and place."""
    from pyspark.sql import Window as W

    placed = running_totals(rows.select(value, key), [F.col(key)], {})
    numbered = stage(placed.select(value, (F.col("position") - 1).alias("i")), "bootstrap")
    total = numbered.agg(F.count("*").alias("total"))
    draws = numbered.select("i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).crossJoin(F.broadcast(total))
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "i")), 1, 8), 16, 10).cast("long")
    picked = draws.select("b", (word % F.col("total")).alias("pick")).join(numbered.withColumnRenamed("i", "pick"), "pick")
    means = picked.groupBy("b").agg(F.avg(value).alias("m"))
    ordered = means.withColumn("r", F.row_number().over(W.orderBy("m")))
    low, high = int(0.025 * resamples) + 1, int(0.975 * resamples) + 1
    return ordered.agg(F.round(F.min(F.when(F.col("r") == low, F.col("m"))), 6).alias("low"), F.round(F.min(F.when(F.col("r") == high, F.col("m"))), 6).alias("high"))


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of all they break."""
    named = F.array_join(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])), ",")
    return rows.withColumn("reasons", named).where("reasons <> ''")


def leaking_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows are in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def multilabel_scores(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per label: true and false positives, false negatives and F1 from (key, label) rows."""
    joined = truth.withColumn("t", F.lit(1)).join(found.withColumn("p", F.lit(1)), [key, "label"], "full")
    table = joined.groupBy("label").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return table.select("label", "tp", "fp", "fn", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def group_draws(rows: DataFrame, group: str, resamples: int, seed: str) -> DataFrame:
    """(group, times): how often each group is drawn in each resample, as an array; as many draws as there are groups.

    Draws are digests of seed, resample and place, so any engine repeats them.
    """
    placed = running_totals(rows.select(group).distinct(), [F.col(group)], {})
    numbered = stage(placed.select(group, (F.col("position") - 1).alias("i")), "bootstrap")
    total = numbered.agg(F.count("*").alias("total"))
    draws = numbered.select("i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).crossJoin(F.broadcast(total))
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "i")), 1, 8), 16, 10).cast("long")
    drawn = draws.groupBy((word % F.col("total")).alias("i"), "b").agg(F.count("*").cast("int").alias("n"))
    of = F.map_from_entries(F.collect_list(F.struct("b", "n")))  # one entry for each resample at most
    times = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda b: F.coalesce(F.col("of")[b], F.lit(0)))
    return drawn.groupBy("i").agg(of.alias("of")).withColumn("times", times).join(numbered, "i").select(group, "times")


#: Resamples that a task works on at once.
RESAMPLES_AT_ONCE = 64


def _tie_sums(score: np.ndarray, gold: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores of sorted rows, and the weights of positives and negatives at each, by resample."""
    starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    positive = np.add.reduceat(times * gold[:, None], starts, axis=0)
    return score[starts], positive, np.add.reduceat(times, starts, axis=0) - positive


def weighted_curves(rows: DataFrame, threshold: float, resamples: int) -> DataFrame:
    """(b, positives, negatives, auroc, auprc, f1) of every resample from rows (score, gold, times).

    The rows are sorted once into range partitions. A first pass gives the weights of each partition, and of its first and
    last score; the driver, which gets partitions times resamples numbers, adds them up, so that a second pass knows what is
    above each partition and what its last score has in the next ones. No row is repeated for a draw, a score may fill any
    number of partitions, and a task holds one of them.
    """
    spark = rows.sparkSession
    fine = rows.where("score is not null and gold is not null").select("score", F.col("gold").cast("long").alias("gold"), "times")
    placed = stage(fine.orderBy(F.desc("score"), F.xxhash64("times")).withColumn("part", F.spark_partition_id()), "curve-rows")

    def matrix(table: pa.Table, at: int) -> np.ndarray:
        flat = np.array(table["times"].combine_chunks().flatten(), np.int64).reshape(table.num_rows, resamples)
        return flat[:, at : at + RESAMPLES_AT_ONCE]

    def columns(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = table.sort_by([("score", "descending")])
        return table, np.array(table["score"]), np.array(table["gold"])

    def weigh(table: pa.Table) -> pa.Table:
        table, score, gold = columns(table)
        parts = [_tie_sums(score, gold, matrix(table, at)) for at in range(0, resamples, RESAMPLES_AT_ONCE)]
        join = lambda pick: [int(x) for p in parts for x in pick(p)]
        cells = {"p": join(lambda p: p[1].sum(0)), "n": join(lambda p: p[2].sum(0)), "fp": join(lambda p: p[1][0]), "fn": join(lambda p: p[2][0]), "lp": join(lambda p: p[1][-1]), "ln": join(lambda p: p[2][-1])}
        one = {"part": [int(table["part"][0].as_py())], "first": [float(score[0])], "last": [float(score[-1])], **{k: [v] for k, v in cells.items()}}
        return pa.table(one, schema=pa.schema([("part", pa.int32()), ("first", pa.float64()), ("last", pa.float64()), *[(k, pa.list_(pa.int64())) for k in cells]]))

    schema = "part int, first double, last double, " + ", ".join(f"{k} array<long>" for k in ("p", "n", "fp", "fn", "lp", "ln"))
    weighed = sorted(placed.groupBy("part").applyInArrow(weigh, schema).collect(), key=lambda r: r["part"])  # one row for each partition
    zeros = np.zeros(resamples, np.int64)
    total_p, total_n = (sum((np.array(r[k]) for r in weighed), zeros) for k in ("p", "n"))
    plan: dict[int, tuple] = {}
    above_p, above_n, carried = zeros, zeros, None
    for k, r in enumerate(weighed):
        rest_p, rest_n = zeros, zeros
        for later in weighed[k + 1 :]:
            if later["first"] != r["last"]:
                break
            rest_p, rest_n = rest_p + np.array(later["fp"]), rest_n + np.array(later["fn"])
            if later["last"] != r["last"]:
                break
        plan[r["part"]] = (above_p, above_n, carried == r["first"], rest_p, rest_n)
        above_p, above_n, carried = above_p + np.array(r["p"]), above_n + np.array(r["n"]), r["last"]

    def measure(table: pa.Table) -> pa.Table:
        before_p, before_n, skip, rest_p, rest_n = plan[int(table["part"][0].as_py())]
        table, score, gold = columns(table)
        found: dict[str, list[float]] = {k: [] for k in ("area", "gain", "tp", "fp")}
        for at in range(0, resamples, RESAMPLES_AT_ONCE):
            own = slice(at, at + RESAMPLES_AT_ONCE)
            value, p, n = _tie_sums(score, gold, matrix(table, at))
            over = value >= threshold
            found["tp"] += p[over].sum(0).tolist()
            found["fp"] += n[over].sum(0).tolist()
            p[-1], n[-1] = p[-1] + rest_p[own], n[-1] + rest_n[own]
            tp, fp = before_p[own] + np.cumsum(p, 0), before_n[own] + np.cumsum(n, 0)
            if skip:  # the partition before has counted this score for all
                p, n, tp, fp = p[1:], n[1:], tp[1:], fp[1:]
            found["area"] += (p * ((total_n[own] - fp) + n / 2)).sum(0).tolist()
            found["gain"] += (p * (tp / np.maximum(tp + fp, 1))).sum(0).tolist()
        return pa.table({"b": pa.array(range(resamples), pa.int32()), **{k: pa.array([float(x) for x in v]) for k, v in found.items()}})

    parts = placed.groupBy("part").applyInArrow(measure, "b int, area double, gain double, tp double, fp double")
    sums = parts.groupBy("b").agg(*[F.sum(k).alias(k) for k in ("area", "gain", "tp", "fp")])
    totals = spark.createDataFrame([(b, int(p), int(n)) for b, (p, n) in enumerate(zip(total_p, total_n))], "b int, positives long, negatives long")
    both = totals.join(sums, "b")
    auroc = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("area") / (F.col("positives") * F.col("negatives"))).otherwise(0.5)
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), F.lit(0.0))
    return both.select("b", "positives", "negatives", auroc.alias("auroc"), ratio(F.col("gain"), F.col("positives")).alias("auprc"), f1.alias("f1"))


def group_bootstrap(rows: DataFrame, group: str, first: tuple[str, float], second: tuple[str, float], resamples: int, seed: str) -> DataFrame:
    """(metric, observed, low, high, mean, valid): differences of two methods' AUROC, average precision and F1 when whole
    groups are drawn again and again, with 2.5 and 97.5 percentiles (linear).

    rows: gold (0 or 1), the group and both scores; a method is its score's column and its threshold. Resamples with one
    class are skipped; fewer than ten that are left give no interval.
    """
    rows = stage(rows.where(F.col("gold").isNotNull() & F.col(group).isNotNull()).select(group, "gold", *{first[0]: 0, second[0]: 0}), "bootstrap-rows")
    drawn = stage(group_draws(rows, group, resamples, seed), "bootstrap-draws")
    joined = attach(rows, drawn, [group], spread_by=first[0])
    times = F.coalesce("times", F.array_repeat(F.lit(0), resamples))
    curve = lambda score, at, weights, n: weighted_curves(joined.select(F.col(score).alias("score"), "gold", weights.alias("times")), at, n)
    metrics = ("auroc", "auprc", "f1")

    def differences(weights: Column, n: int) -> DataFrame:
        a, b = (curve(score, at, weights, n) for score, at in (first, second))
        both = a.where("positives > 0 and negatives > 0").join(b.select("b", *[F.col(m).alias(f"other_{m}") for m in metrics]), "b")
        return both.select("b", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) - F.col(f"other_{m}")).alias("d")) for m in metrics])).alias("x")).select("b", "x.metric", "x.d")

    enough = F.count("*") >= 10
    at = lambda share: F.when(enough, F.round(F.percentile("d", share), 6))
    found = differences(times, resamples).groupBy("metric").agg(at(0.025).alias("low"), at(0.975).alias("high"), F.when(enough, F.round(F.avg("d"), 6)).alias("mean"), F.count("*").alias("valid"))
    observed = differences(F.array(F.lit(1)), 1).select("metric", F.round("d", 6).alias("observed"))
    return observed.join(found, "metric", "left").select("metric", "observed", "low", "high", "mean", F.coalesce("valid", F.lit(0)).alias("valid"))


def report(rows: DataFrame, votes: DataFrame, bucket: Column) -> DataFrame:
    """(part, name, pairs, positives, mean_score): all pairs, those that each origin voted on, and those of each bucket."""
    sums = [F.count("*").alias("pairs"), F.sum("gold").alias("positives"), F.round(F.avg("sim_score"), 6).alias("mean_score")]
    of = lambda df, part, name: df.groupBy(F.lit(part).alias("part"), name.alias("name")).agg(*sums)
    voted = rows.join(votes.select("pair_id", "origin").distinct(), "pair_id")
    return of(rows, "overall", F.lit("all")).unionByName(of(voted, "origin", F.col("origin"))).unionByName(of(rows, "bucket", bucket))


def progress(pairs: DataFrame, votes: DataFrame) -> DataFrame:
    """Per split: pairs, labelled ones, those that several people judged, agreed and disagreed ones, and their share."""
    people = votes.where("origin = 'HUMAN'").groupBy("pair_id").agg(F.count_distinct("annotator").alias("voters"), F.count_distinct("label").alias("labels"))
    seen = votes.select("pair_id").distinct().withColumn("voted", F.lit(1))
    rows = pairs.join(seen, "pair_id", "left").join(people, "pair_id", "left")
    several = F.col("voters") >= 2
    table = rows.groupBy("split").agg(F.count("*").alias("pairs"), F.count("voted").alias("labelled"), F.count_if(several).alias("several"), F.count_if(several & (F.col("labels") == 1)).alias("agreed"))
    return table.withColumn("disagreed", F.col("several") - F.col("agreed")).withColumn("agreement", F.round(F.when(F.col("several") > 0, F.col("agreed") / F.col("several")), 6))


def export_records(pairs: DataFrame, votes: DataFrame) -> DataFrame:
    """pairs with n_votes, the people's consensus (null without), and the reason why a pair is left out of an export."""
    counts = votes.groupBy("pair_id").agg(F.count("*").alias("n_votes"))
    rows = pairs.join(counts, "pair_id", "left").join(human_consensus(votes).select("pair_id", F.col("label").alias("consensus")), "pair_id", "left")
    rows = rows.withColumn("n_votes", F.coalesce("n_votes", F.lit(0)).cast("long"))
    reason = F.when(F.col("gold").isNull(), "no gold label").when(F.col("n_votes") == 0, "no votes").when(F.col("consensus").isNull(), "no consensus")
    return rows.withColumn("excluded", reason)


def moved_groups(rows: DataFrame, assigned: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose assigned split (group, split) is not the one their rows have, or which have no assignment."""
    right = assigned.select(group, F.col(split).alias("assigned"))
    return rows.select(group, split).distinct().join(right, group, "left").where(~F.col(split).eqNullSafe(F.col("assigned"))).select(group, split, "assigned")


def ablations(signals: DataFrame, names: list[str]) -> DataFrame:
    """Signals repeated once per ablation, less the signal it leaves out: (ablation, claim_id, name, value)."""
    kinds = F.explode(F.array(F.lit("none"), *[F.lit(n) for n in names]))
    return signals.withColumn("ablation", kinds).where("ablation <> name")
