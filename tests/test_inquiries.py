"""Evidence checks, lineages, alert conditions, weak labels and queues against hand values."""

import math

import pytest

from newsloom.operators import alerts, features, inquiry, ranking, verdicts
from newsloom.plans.staging import running_totals


def test_claim_check(spark):
    base = [
        (1, [1.0, 0.0], "own", 1, 5, 5, 5), (2, [1.0, 0.01], "own", 2, 5, 5, 5), (3, [1.0, 0.02], "a", 1, 5, 5, 5), (4, [1.0, 0.03], "a", 4, 5, 5, 5),
        (5, [1.0, 0.04], "b", 4, 5, 5, 5), (6, [1.0, 0.05], "a", 6, None, 5, 5), (7, [1.0, 0.06], "b", 7, 5, 5, 5), (8, [1.0, 0.0], "c", 8, 5, 5, 99), (9, [0.0, 1.0], "d", 9, 5, 5, 5),
    ]
    rows = spark.createDataFrame(base, "id long, v array<double>, domain string, origin long, published_s long, collected_s long, extracted_s long")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "own", 1), (50, [-1.0, 0.0], None, None)], "q long, qv array<double>, own_domain string, own_origin long")
    stances = spark.createDataFrame([(1, 4, "entailment"), (1, 7, "contradiction")], "q long, id long, stance string")
    found = inquiry.check_claims(asked, rows, stances, cutoff_s=10, limit=3).orderBy("q", "turn").collect()
    assert [(r["q"], r["turn"], r["id"], r["stance"], r["assessment"]) for r in found] == [
        (1, 1, 4, "entailment", "mixed"), (1, 2, 7, "contradiction", "mixed"), (1, 3, 6, "neutral", "mixed"), (50, None, None, None, "insufficient"),
    ]
    assert found[0]["warnings"] == [inquiry.NO_TIME] and found[3]["warnings"] == [inquiry.NO_EVIDENCE]
    past = inquiry.check_claims(asked, rows, stances, cutoff_s=10, limit=3, historical=True).where("q = 1").collect()
    assert {r["id"] for r in past} == {4, 7}


def test_lineages_are_bounded_and_best_first(spark):
    edges = [(0, i, i / 100) for i in range(1, 20)] + [(19, 30, 0.9), (30, 31, 0.9), (31, 32, 0.9), (40, 41, 0.5)]
    times = [(i, None if i == 41 else 100 - i) for i in [*range(20), 30, 31, 32, 40, 41, 50]]
    roots = spark.createDataFrame([(0,), (30,), (40,), (50,)], "root long")
    found = inquiry.lineages(spark.createDataFrame(edges, "a long, b long, score double"), spark.createDataFrame(times, "node long, published_s long"), roots)
    got = {}
    for r in found.collect():
        got.setdefault(r["root"], []).append((r["place"], r["node"], r["truncated"]))
    assert sorted(n for _, n, _ in got[0]) == [0, *range(9, 20)] and all(t for *_, t in got[0])
    assert sorted(n for _, n, _ in got[30]) == [0, *range(12, 20), 30, 31, 32]
    assert sorted(got[40]) == [(1, 40, False), (2, 41, False)] and 50 not in got


def test_alert_conditions(spark):
    claims = spark.createDataFrame([(i, 100 + i) for i in range(60)], "claim_id long, extracted_s long")
    signals = spark.createDataFrame([(1, 0.3, 0.9), (2, 0.29, 0.6), (3, None, 0.5), (4, None, None)], "claim_id long, ratio double, corroboration double")
    changes = spark.createDataFrame([(5, 6, 120, "NUMERIC_DRIFT,WORDING_DRIFT", True), (7, 8, 121, "WORDING_DRIFT", True), (9, 8, 50, "NUMERIC_DRIFT", True), (7, 9, 130, "NEAR_DUPLICATE", False)], "from_id long, to_id long, created_s long, types string, meaningful boolean")
    clusters = spark.createDataFrame([(i, 1, i % 7) for i in range(60)], "claim_id long, run int, topic int")
    found = [tuple(r) for r in alerts.conditions(claims, signals, changes, clusters, since=100).collect()]
    assert found[:4] == [("CORROBORATION", "INFO", "claim:2"), ("CONTRADICTION", "CRITICAL", "claim:1"), ("MUTATION", "INFO", "edge:7:8"), ("MUTATION", "WARNING", "edge:5:6")]
    assert [f for f in found[4:]] == [("SPIKE", "WARNING", f"cluster:1:{t}") for t in (0, 1, 2, 3, 4, 5, 6)][:7] and len(found) == 11
    assert alerts.conditions(claims, signals, changes, clusters, since=100, most=3).count() == 3


def test_claim_graph_falls_back_to_neighbours(spark):
    claims = spark.createDataFrame([(1, 0.9, [1.0, 0.0]), (2, 0.8, [1.0, 0.1]), (3, None, [0.0, 1.0]), (4, 0.1, [0.1, 1.0])], "claim_id long, confidence double, v array<double>")
    edges = spark.createDataFrame([(2, 1, "EVOLVED_FROM"), (3, 1, "SIMILAR_TO")], "from_id long, to_id long, kind string")
    assert [tuple(r) for r in verdicts.claim_graph(claims, edges, 3, 1).collect()] == [(2, 1, "EVOLVED_FROM", "persisted")]
    found = verdicts.claim_graph(claims, edges.where("from_id = 3"), 3, 1).collect()
    assert sorted((r["from_id"], r["to_id"], r["source"]) for r in found) == [(1, 2, "nearest"), (2, 4, "nearest")]


def test_pair_tfidf_cosine(spark):
    rows = spark.createDataFrame([(1, "abc", "abc"), (2, "abc", "xyz"), (3, "ab ab", "ab"), (4, "", "x")], "pair int, a string, b string")
    found = {r["pair"]: r["cosine"] for r in features.pair_tfidf_cosine(rows).collect()}
    assert found[1] == pytest.approx(1) and found[2] == 0 and 3 in found
    assert found[3] == pytest.approx(1) and found.get(4, 0.0) == 0 and math.isfinite(sum(found.values()))


def test_next_pair_and_running_totals(spark):
    pairs = spark.createDataFrame([(i, "train" if i % 2 else "dev", 0.6 + (i - 5) / 100) for i in range(1, 11)], "pair_id long, split string, sim_score double")
    votes = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", 5), *[("d", i) for i in range(1, 11)]], "annotator string, pair_id long")
    assert sorted(tuple(r) for r in ranking.next_pair(pairs, votes).collect()) == [("a", 3), ("b", 1), ("c", 1)]
    assert sorted(tuple(r) for r in ranking.next_pair(pairs, votes, True).collect()) == [("a", 5), ("b", 5), ("c", 3)]
    rows = spark.range(500).selectExpr("id", "id % 7 as n").repartition(9)
    found = sorted(tuple(r) for r in running_totals(rows, [rows["id"].desc()], {"upto": "n"}).select("id", "position", "upto").collect())
    assert found == [(i, 500 - i, sum(k % 7 for k in range(i, 500))) for i in range(500)]
