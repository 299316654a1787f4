"""Domain operators: hand values on small tables, and registered queries against their SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import aggregates, alerts, evaluation, graph, listing, merging, neardup, ranking, vectors, verdicts
from newsloom.operators.components import connected_components
from newsloom.plans import assessments, catalog, inquiries, intake
from newsloom.plans.staging import running_counts, stage

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# every query that has SQL: the modules register theirs in the catalogue's table
CHECKED = sorted(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else repr(value)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    result = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(result.columns) == names
    want = sorted(tuple(plain(row[result.columns.index(c)]) for c in names) for row in result.fetchall())
    assert got == want


def test_every_query_is_callable():
    assert assessments and inquiries and intake
    assert len(catalog.QUERIES) > 90 and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert os.path.exists("/root/testdata")


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_text_functions(spark):
    assert value(spark, tx.clean_markup, "<p>This is   some <b>messy</b> text&amp;more.</p>\n\n  \n<br>Yes.") == "This is some messy text&more.\nYes."
    assert value(spark, tx.canonical_host, "HTTPS://user@WWW.Example.com.:80/x") == "example.com"
    assert value(spark, tx.word_count, "a  b\nc") == 3 and value(spark, tx.word_count, "") is None
    assert value(spark, tx.tokens, "It's $1,200.50 or 5%!") == ["it's", "$1,200.50", "or", "5%", "!"]
    assert value(spark, lambda c: tx.lexicon_tokens(c, "scope"), "At least all of them") == ["all", "at least"]
    assert value(spark, lambda c: tx.lexicon_tokens(c, "polarity"), "It is not false") == ["not", "false"]
    assert value(spark, tx.entity_tokens, "The Alice met BB and xy in Rome") == ["Alice", "BB", "Rome"]
    assert value(spark, tx.claim_worthiness, "The minister said that 12 people were seen near the old harbour") == 0.85
    assert value(spark, tx.claim_worthiness, "I love it") == pytest.approx(0.2)
    assert value(spark, tx.csv_safe, "=1+1") == "'=1+1" and value(spark, tx.csv_safe, "a=1") == "a=1"


def test_text_change_types(spark):
    pairs = [("The cost was 1,200.50 dollars today", "The cost was 1,800.75 dollars today", "NUMERIC_DRIFT"), ("Alice met them today again here", "Bob met them today again here", "ENTITY_SUBSTITUTION"), ("It is true", "It is not true", "POLARITY_SHIFT"), ("All of them left", "Some of them left", "SCOPE_SHIFT"), ("Same words", "same  words", "NEAR_DUPLICATE")]
    rows = verdicts.text_change(spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")).orderBy("i").collect()
    assert all(want in r["types"].split(",") for r, (_, _, want) in zip(rows, pairs))
    assert [r["meaningful"] for r in rows] == [True, True, True, True, False]


def scored(spark, pairs):
    return spark.createDataFrame([(i, float(s), g) for i, (s, g) in enumerate(pairs)], "pair_id int, sim_score double, gold int")


def test_metrics_by_hand(spark):
    rows = scored(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)])
    assert evaluation.auroc(rows).first()["auroc"] == 0.875
    assert evaluation.auroc(scored(spark, [(0.5, 1)])).first()["auroc"] == 0.5
    assert evaluation.average_precision(rows).first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-6)
    assert evaluation.best_threshold(rows).first()["threshold"] == 0.8
    assert evaluation.brier(scored(spark, [(0.9, 1), (0.1, 0), (0.8, 1), (0.0, 0)])).first()["brier"] == 0.015
    metrics = evaluation.binary_metrics(rows, 0.8).first()
    assert (metrics["tp"], metrics["fp"], metrics["fn"]) == (2, 1, 0)
    assert evaluation.binary_metrics(scored(spark, [(0.1, 0)]), 0.8).first()["precision"] is None
    assert [r["bin"] for r in evaluation.reliability(scored(spark, [(0.0, 0), (0.1, 0), (0.11, 1), (1.0, 1)])).orderBy("bin").collect()] == [0, 1, 9]


def test_consensus(spark):
    votes = [(1, "a", "HUMAN", "X"), (1, "b", "HUMAN", "X"), (2, "a", "HUMAN", "X"), (2, "b", "HUMAN", "Y"), (3, "a", "HUMAN", "X"), (3, "c", "WEAK", "Y")]
    frame = spark.createDataFrame(votes, "pair_id int, annotator string, origin string, label string")
    assert [r["pair_id"] for r in evaluation.human_consensus(frame).collect()] == [1]
    assert {(r["pair_id"], r["origin"], r["label"]) for r in evaluation.weak_majority(frame).collect()} == {(1, "HUMAN", "X"), (3, "HUMAN", "X"), (3, "WEAK", "Y")}
    kappa = evaluation.cohen_kappa(frame.where("origin = 'HUMAN'")).first()
    assert kappa["items"] == 2 and kappa["kappa"] == 0.0


def test_components_of_odd_graphs(spark):
    path = [(i, i + 1) for i in range(1, 80)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    ring = [(5000 + i, 5000 + (i + 1) % 30) for i in range(30)]
    edges = spark.createDataFrame(path + star + ring + [(7, 7), (9000, 9000)], "a long, b long").union(spark.createDataFrame([(None, 3)], "a long, b long"))
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {found[n] for n in range(1, 81)} == {1} and {found[1000 + i] for i in range(200)} == {1000} and {found[5000 + i] for i in range(30)} == {5000}
    assert connected_components(edges.limit(0)).count() == 0


def test_graph_operators(spark):
    chain = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.5)], "a long, b long, score double")
    roots = spark.createDataFrame([(1,)], "root long")
    profile = graph.reach_profile(chain, roots, 0.99, 3).first()
    assert profile["reached"] == 3 and profile["expected"] == pytest.approx(0.95 + 0.95**2 + 0.95**3, abs=1e-5)
    relations = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "from_id long, to_id long")
    assert graph.longest_chain(relations).first()["longest_chain"] == 2
    assert graph.longest_chain(relations.limit(0)).first()["longest_chain"] == 0
    claims = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "claim_id long, published_s long")
    edges = spark.createDataFrame([(2, 1, "EVOLVED_FROM", 0.88), (3, 2, "EVOLVED_FROM", 0.91), (3, 1, "SIMILAR_TO", 0.78)], "from_id long, to_id long, kind string, score double")
    quality = graph.graph_quality(edges, claims).first()
    assert (quality["temporal_validity"], quality["score_consistency"], quality["mean_out_degree"]) == (1.0, 1.0, 1.5)
    rows = spark.createDataFrame([(1, "x", None), (2, "x", "p"), (3, "y", "p"), (4, None, None)], "id long, u string, h string")
    assert {r["id"]: r["component"] for r in graph.token_components(rows, "id", ["u", "h"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_alert_rules(spark):
    now = 1_000_000
    times = spark.createDataFrame([(now - 10,)] * 6 + [(now - 100_000,), (now + 50,), (None,)], "at_s long")
    counts = alerts.recent_and_prior(times, "INGESTION_SPIKE", now)
    assert tuple(counts.first()) == ("INGESTION_SPIKE", 6, 1)
    assert [r["kind"] for r in alerts.snapshot_alerts(counts).collect()] == ["INGESTION_SPIKE"]
    even = alerts.recent_and_prior(times.where("at_s > 950000").union(spark.createDataFrame([(now - 100_000,)] * 6, "at_s long")), "INGESTION_SPIKE", now)
    assert [r["kind"] for r in alerts.snapshot_alerts(even).collect()] == ["QUIET"]


def test_near_duplicate_articles(spark):
    words = [f"w{i}" for i in range(1, 33)]
    near, far = list(words), list(words)
    near[0], near[3] = "x1", "x2"
    far[0], far[9], far[19] = "x1", "x2", "x3"
    rows = [(1, " ".join(words), 100), (2, " ".join(near), 200), (3, " ".join(far), 300), (4, " ".join(words), 50), (5, None, 10), (6, " ".join(near), 200 + 40 * 86_400)]
    found = {r["id"]: r["canonical_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "id long, text string, at_s long")).collect()}
    assert found == {1: 4, 2: 4, 3: 3, 4: 4, 5: 5, 6: 4}


def test_nearest_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "id long, v array<float>")
    asked = rows.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    for block in (1, 100):
        found = vectors.nearest(asked, rows, 2, block).orderBy("q", "place").collect()
        assert [(r["q"], r["id"]) for r in found] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 2), (3, 0)]


def test_signals(spark):
    claims = spark.createDataFrame([(1, "a", "plain words only here now ok"), (2, "a", "x")], "claim_id long, domain string, claim_text string")
    evidence = spark.createDataFrame([(1, "a", "g1", "entailment"), (1, "b", "g2", "entailment"), (1, "c", "g2", "entailment"), (1, "d", "g3", "contradiction")], "claim_id long, domain string, syndication_group string, stance string")
    found = {r["claim_id"]: r for r in verdicts.corroboration(claims, evidence).collect()}
    assert (found[1]["support"], found[1]["against"]) == (1, 1) and found[1]["corroboration"] == round(0.35 + 0.65 * (1 - math.exp(-1 / 1.5)), 3)
    assert found[2]["corroboration"] == 0.3 and found[2]["contradiction"] == 0.5
    priors = spark.createDataFrame([("a", 4, 4)], "domain string, supported int, checked int")
    assert verdicts.track_record(claims, priors).first()["signal"] == 0.75
    assert verdicts.score_claims(claims, evidence, priors).where("claim_id = 1").first()["band"] in ("DISPUTED", "UNRESOLVED")


def test_ranking_and_merging(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "a")], "r int, d string")
    assert [r["r"] for r in ranking.round_robin(rows, "d", "r", 4).collect()] == [1, 3, 4, 2]
    ranks = ranking.average_ranks(spark.createDataFrame([(0.1,), (0.5,), (0.5,), (0.9,)], "s double"), "s")
    assert sorted(r["avg_rank"] for r in ranks.collect()) == [1.0, 2.5, 2.5, 4.0]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, keep string, v int")
    new = spark.createDataFrame([(2, "z", 9), (3, "c", 3)], "k int, keep string, v int")
    merged = {r["k"]: (r["keep"], r["v"]) for r in merging.upsert(old, new, ["k"], ["v"], ["keep"]).collect()}
    assert merged == {1: ("a", 1), 2: ("b", 9), 3: ("c", 3)}
    page = listing.list_verdicts(spark.createDataFrame([(1, 0.5, "X", "d")], "claim_id long, probability double, verdict string, domain string"), offset=10)
    assert [(r["total"], r["claim_id"]) for r in page.collect()] == [(1, None)]
    votes = spark.createDataFrame([(1, "HUMAN")], "pair_id int, origin string")
    assert {r["origin"]: r["votes"] for r in aggregates.vote_provenance(votes, ["HUMAN", "WEAK"]).collect()} == {"HUMAN": 1, "WEAK": 0}


def test_running_counts(spark):
    rows = stage(spark.range(3000).select((F.col("id") * 7).alias("b"), F.lit(2).cast("long").alias("n")), "t")
    found = running_counts(rows, "b", "n", group_bits=5)
    assert found.where("before <> b / 7 * 2").isEmpty() and found.count() == 3000
