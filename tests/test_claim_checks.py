"""Claim checks with passages and shared vectors, typed edges, factors, consensus on types, entity overlap and CSV cells."""

from pyspark.sql import functions as F

from newsloom.operators import evaluation, exports, features, inquiry, verdicts

BASE = "id long, v array<double>, domain string, origin long, published_s long, collected_s long, extracted_s long, text string, article_id long, vec long"
ASKED = "q long, qv array<double>, own_domain string, own_origin long, q_text string"


def test_claims_share_vectors_and_passages_are_judged(spark):
    rows = [(8 * a + p, v, d, a, 5, 5, 5, t, a, a) for a, v, d, texts in (
        (0, [1.0, 0.0], "own", ["Rates rise by 5 points", "another line of it"]),
        (1, [1.0, 0.1], "x", ["Rates rise by 5 points today", "more of this"]),
        (2, [1.0, 0.2], "y", ["Rates rise by 7 points", "and so on"]),
    ) for p, t in enumerate(texts)]
    base = spark.createDataFrame(rows, BASE)
    asked = spark.createDataFrame([(0, [1.0, 0.0], "own", 0, "Rates rise by 5 points")], ASKED)
    bodies = spark.createDataFrame([(1, "An opening. Rates rise by 5 points today. " + "x" * 1200), (2, None)], "article_id long, content string")
    judge = verdicts.stance_by_words(F.col("q_text"), F.col("passage"))
    plain = inquiry.check_claims(asked, base, None, 10, judge=judge).orderBy("turn").collect()
    assert [(r["id"], r["stance"], r["assessment"]) for r in plain] == [(8, "entailment", "mixed"), (16, "contradiction", "mixed")]
    shown = inquiry.check_claims(asked, base, None, 10, judge=judge, articles=bodies).orderBy("turn").collect()
    assert [(r["passage"], r["passage_source"]) for r in shown] == [("An opening. Rates rise by 5 points today.", "content"), ("Rates rise by 7 points", "extracted_claim")]
    assert shown[0]["warnings"] == [inquiry.EXTRACTED]
    empty = inquiry.check_claims(asked, base.limit(0), None, 10, judge=judge, articles=bodies).collect()
    assert [(r["q"], r["id"], r["assessment"]) for r in empty] == [(0, None, "insufficient")] and empty[0]["warnings"] == [inquiry.NO_EVIDENCE]


def test_nearest_claims_equal_a_plain_search(spark):
    rows = [(8 * a + p, [1.0, ((a * 37) % 50) / 10], a) for a in range(50) for p in range(a % 3 + 1)]
    held = spark.createDataFrame(rows, "id long, v array<double>, vec long")
    got = inquiry.nearest_claims(spark.createDataFrame([(0, [1.0, 0.0]), (999, [0.0, 1.0])], "q long, qv array<double>"), held, 7).collect()
    for q, x in ((0, [1.0, 0.0]), (999, [0.0, 1.0])):
        cosine = lambda v: (x[0] * v[0] + x[1] * v[1]) / (v[0] ** 2 + v[1] ** 2) ** 0.5
        best = sorted((-cosine(v), i) for i, v, _ in rows if i != q)[:7]
        assert sorted(r["id"] for r in got if r["q"] == q) == sorted(i for _, i in best)


def test_typed_mutations(spark):
    texts = spark.createDataFrame([(1, "Prices rose 5% in May"), (2, "prices rose 5% in may"), (3, "Prices rose 9% in May"), (4, None)], "id long, text string")
    found = spark.createDataFrame([(2, 1, 0.9), (3, 2, 0.95), (3, 1, 0.94), (4, 1, 0.9)], "child long, parent long, score double")
    got = {(r["child"], r["parent"]): (r["kind"], r["types"]) for r in inquiry.typed_mutations(found, texts, 0.85, 0.75).collect()}
    assert got[2, 1] == ("SIMILAR_TO", None) and got[3, 1] == ("SIMILAR_TO", None)
    assert got[3, 2][0] == "EVOLVED_FROM" and "NUMERIC_DRIFT" in got[3, 2][1]
    assert got[4, 1] == ("SIMILAR_TO", None)


def test_strongest_factors(spark):
    rows = [(1, "corroboration", 0.5), (1, "contradiction", 0.5), (1, "track_record", 0.9), (1, "entity_grounding", 0.1), (1, "language", 0.99), (2, "language", 0.2)]
    got = [tuple(r) for r in verdicts.strongest_factors(spark.createDataFrame(rows, "claim_id long, name string, value double")).orderBy("claim_id", "place").collect()]
    assert got == [(1, 1, "language", "raises", 0.99), (1, 2, "track_record", "raises", 0.9), (2, 1, "language", "lowers", 0.2)]


def test_typed_consensus(spark):
    votes = [
        (1, "a", "HUMAN", "X", ["p", "q"]), (1, "b", "HUMAN", "X", ["q", "p", "q"]), (2, "a", "HUMAN", "X", ["p"]), (2, "b", "HUMAN", "X", None),
        (3, "a", "HUMAN", "X", ["p"]), (3, "b", "HUMAN", "X", ["q"]), (4, "a", "HUMAN", "X", ["p"]), (4, "b", "HUMAN", "Y", ["p"]), (5, "a", "HUMAN", "X", ["p"]), (5, "w", "WEAK", "Y", ["p"]),
        (6, "a", "HUMAN", "X", None), (6, "b", "HUMAN", "X", None), (7, "a", "HUMAN", "X", []), (7, "b", "HUMAN", "X", []),
    ]
    frame = spark.createDataFrame(votes, "pair_id long, annotator string, origin string, label string, mutation_types array<string>")
    got = {r["pair_id"]: (r["status"], r["mutation_status"], r["mutation_types"]) for r in evaluation.typed_consensus(frame).collect()}
    assert got == {
        1: ("agreed", "agreed", "p,q"), 2: ("agreed", "incomplete", None), 3: ("agreed", "disagreement", None), 4: ("disagreement", "not_annotated", None),
        5: ("needs_human_votes", "not_annotated", None), 6: ("agreed", "not_annotated", None), 7: ("agreed", "agreed", ""),
    }


def test_entity_overlap(spark):
    rows = [("Acme Corp paid $5", "Acme Corp paid $5"), ("Iran spoke", "Iranian spoke"), ("nothing here", "Iran spoke"), (None, "Iran")]
    sets = spark.createDataFrame(rows, "a string, b string").select(features.entity_set(F.col("a")).alias("x"), features.entity_set(F.col("b")).alias("y"))
    got = [r[0] for r in sets.select(features.entity_overlap(F.col("x"), F.col("y"))).collect()]
    # acme corp, acme, corp, $5 on both sides: four shared, and each of the words lies in the name, both ways
    assert got == [1.3, 0.1, None, None]


def test_predictions_keep_their_cells(spark):
    cells = ["=1+1", "-x", "a,b", 'say "so"', "two\nlines", " blanks ", "", None, "\\", "plain", "@x\n=y"]
    rows = spark.createDataFrame(list(enumerate(cells)), "id long, cell string")
    got = {r["id"]: r["cell"] for r in exports.write_predictions(rows).collect()}
    assert got == dict(enumerate(["'=1+1", "'-x", *cells[2:6], None, *cells[7:10], "'@x\n=y"]))
