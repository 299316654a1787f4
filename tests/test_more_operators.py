"""Capped pairs, token differences, sparse vectors, models and group checks."""

import collections
import json
import math

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import changes, evaluation, features, modelling, ranking


def test_capped_pairs_keep_the_cap_and_are_maximal(spark):
    rows = [(a, b, (a * 7 + b * 13) % 100 / 100) for a in range(12) for b in range(a + 1, 12)]
    frame = spark.createDataFrame(rows, "a long, b long, score double")
    taken = [(r["a"], r["b"]) for r in ranking.capped_pairs(frame, [F.desc("score"), "a", "b"], 2).collect()]
    used = collections.Counter(x for pair in taken for x in pair)
    assert max(used.values()) <= 2 and len(set(taken)) == len(taken)
    assert all(used[a] == 2 or used[b] == 2 for a, b, _ in rows if (a, b) not in taken)
    assert ranking.capped_pairs(frame.limit(0), [F.desc("score"), "a", "b"], 2).count() == 0


def test_token_differences(spark):
    rows = spark.createDataFrame([(1, 2, "😀 All left at 5", "😀 Some left at 6"), (3, 4, None, "x"), (5, 6, "same", "SAME")], "from_id long, to_id long, a string, b string")
    found = {r["from_id"]: r for r in changes.token_differences(rows).collect()}
    spans = json.loads(found[1]["changed_spans"])
    assert [(s["older"], s["newer"]) for s in spans] == [([2, 5], [2, 6]), ([14, 15], [15, 16])]
    assert found[5]["ratio"] == 1.0 and json.loads(found[5]["changed_spans"]) == []
    assert found[3]["ratio"] == 0.0


def test_ngram_vectors(spark):
    rows = spark.createDataFrame([(1, "abcd"), (2, "abce"), (3, "zzz")], "id long, text string")
    weights = features.ngram_tfidf(rows, 3, 3)
    norms = weights.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in norms)
    shared, alone = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    want = 2 * shared**2 / (2 * shared**2 + 2 * alone**2)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [(r["a"], r["b"], r["score"]) for r in features.sparse_cosine(weights, pairs).collect()] == [(1, 2, pytest.approx(want))]


def test_topic_clusters_and_noise(spark):
    rows = [(i, [1.0, 0.0]) for i in range(8)] + [(10 + i, [0.0, 1.0]) for i in range(8)] + [(99, [-9.0, -9.0])]
    found = {r["id"]: r["topic_id"] for r in modelling.topic_clusters(spark.createDataFrame(rows, "id long, v array<double>"), 3).collect()}
    assert len({found[i] for i in range(8)}) == 1 and found[99] == -1 and found[0] != found[10]


def test_calibrated_logistic_learns(spark):
    rows = [(i, i // 4, ("train", "dev", "test")[i // 4 % 3], i % 2, float(i % 2) + (i % 5) / 10, None if i % 9 == 0 else 1.0) for i in range(240)]
    frame = spark.createDataFrame(rows, "pair_id long, event_group long, split string, gold int, x double, y double")
    found = modelling.calibrated_logistic(frame, ["x", "y"]).where("split = 'test'")
    assert found.where("(score >= 0.5) <> (gold = 1)").isEmpty() and found.count() == 80


def test_group_checks(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "dev"), (2, "test")], "g long, split string")
    assert [r["g"] for r in evaluation.leaking_groups(rows, "g", "split").collect()] == [1]
    assigned = spark.createDataFrame([(2, "dev")], "g long, split string")
    assert {(r["g"], r["split"]) for r in evaluation.moved_groups(rows, assigned, "g", "split").collect()} == {(1, "train"), (1, "dev"), (2, "test")}


def test_languages_by_words(spark):
    texts = [("the cat is in the house and it is warm", "en"), ("der Hund ist in dem Haus und die Katze", "de"), ("short", None), (None, None)]
    rows = spark.createDataFrame(texts, "t string, want string").select("want", tx.language_by_words(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def _one_pass(rows, limits, cap, used):
    """Plain greedy pass over (bucket, a, b) in order: up to limits per bucket, cap per id."""
    used, taken, full = collections.Counter(used), [], collections.Counter()
    for bucket, a, b in rows:
        if full[bucket] < limits and used[a] < cap and used[b] < cap:
            used.update((a, b))
            full[bucket] += 1
            taken.append((a, b))
    return taken


def test_pairs_by_bucket_and_new_samples_agree_with_one_pass(spark):
    rows = [(a, b, "xyz"[(a * b) % 3], (a + b) % 4 == 0) for a in range(14) for b in range(a + 1, 14) if (a * 5 + b * 3) % 4]
    frame = spark.createDataFrame(rows, "a long, b long, bucket string, same_outlet boolean").withColumn("h", F.xxhash64(F.lit("pairs"), "a", "b"))
    ordered = sorted(frame.collect(), key=lambda r: ("zxy".index(r["bucket"]), r["same_outlet"], r["h"], r["a"], r["b"]))
    ordered = [(r["bucket"], r["a"], r["b"]) for r in ordered]
    expected = _one_pass(ordered, 3, 2, {})
    assert len(expected) >= 7
    assert {(r["a"], r["b"]) for r in ranking.bucketed_pairs(frame.drop("h"), list("zxy"), 3).collect()} == set(expected)
    existing = [(*expected[0][::-1], False), (expected[3][0], 99, False), (expected[3][0], 98, False), (expected[-1][0], 97, True)]
    articles = spark.createDataFrame([(i, i // 2) for i in range(100)], "id long, article_id long")
    frozen = {2 * (expected[-1][0] // 2), 2 * (expected[-1][0] // 2) + 1, 96, 97}
    used = collections.Counter(x for a, b, _ in existing for x in (a, b))
    left = [("", a, b) for a, b in expected if (a, b) != expected[0] and not {a, b} & frozen]
    known = spark.createDataFrame(existing, "a long, b long, frozen boolean")
    found = ranking.new_sample(frame.drop("h"), known, articles, list("zxy"), 3)
    assert {(r["a"], r["b"]) for r in found.collect()} == set(_one_pass(left, 99, 2, used))
    assert ranking.bucketed_pairs(frame.drop("h").limit(0), list("zxy"), 3).count() == 0


def test_topics_have_words_and_small_corpora_none(spark):
    rows = [(i, "red apple pie" if i < 6 else None, [1.0, 0.0]) for i in range(8)] + [(10 + i, "blue whale song the whale", [0.0, 1.0]) for i in range(8)] + [(99, "odd", [-9.0, -9.0]), (100, "lost", None)]
    frame = spark.createDataFrame(rows, "id long, text string, v array<double>")
    found = {r["id"]: r for r in modelling.named_topics(frame, 3).collect()}
    assert len(found) == 17 and found[99]["label"] is None and found[99]["keywords"] is None
    assert found[0]["keywords"] == ["apple", "pie", "red"] and found[0]["label"] == f"{found[0]['topic_id']}_apple_pie_red"
    counts = {"whale": 16, "blue": 8, "song": 8, "the": 8}
    mean = (18 + 40) / 2
    assert found[10]["keywords"] == sorted(counts, key=lambda w: (-round(counts[w] * math.log1p(mean / counts[w]), 9), w))
    few = modelling.named_topics(frame.limit(4), 3).collect()
    assert [(r["topic_id"], r["label"], r["keywords"]) for r in few] == [(-1, None, None)] * 4


def test_ablations_choose_thresholds_on_development_rows(spark):
    rows = [(i, i // 4, ("train", "dev", "test")[i // 4 % 3], i % 2, float(i % 2) + (i % 5) / 10, None if i % 9 == 0 else float(i % 7)) for i in range(180)]
    frame = spark.createDataFrame(rows, "pair_id long, event_group long, split string, gold int, x double, y double")
    found = collections.defaultdict(list)
    for r in modelling.logistic_ablations(frame, ["x", "y"]).collect():
        found[r["method"]].append(r)
    assert set(found) == {"all", "without_x", "without_y"} and all(len(v) == 180 for v in found.values())
    for part in found.values():
        dev = [r for r in part if r["split"] == "dev"]

        def f1(threshold, dev=dev):
            hit = sum(r["gold"] for r in dev if r["score"] >= threshold)
            return round(2 * hit / (sum(r["score"] >= threshold for r in dev) + sum(r["gold"] for r in dev)), 9)

        best = max({r["score"] for r in dev}, key=lambda s: (f1(s), s))
        assert all(r["threshold"] == best and r["predicted"] == (r["score"] >= best) for r in part)
    wrong = {m: sum(r["predicted"] != (r["gold"] == 1) for r in v if r["split"] == "test") for m, v in found.items()}
    assert wrong["without_y"] == 0 == wrong["all"] < wrong["without_x"]
    with pytest.raises(ValueError, match="lack a class"):
        modelling.calibrated_logistic(frame.where("gold = 1"), ["x"])
