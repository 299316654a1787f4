"""Records of labelled pairs, the rules they must meet, and whole changes of texts, by hand values and plain versions."""

import difflib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import spans
from newsloom.functions.text import TOKEN
from newsloom.operators import aggregates, changes, neardup, records
from newsloom.plans import catalog

PAIRS = "pair_id long, event_group long, split string, sim_score double, gold_label string, claim_a_id long, claim_b_id long, text_a string, text_b string"
VOTES = "pair_id long, annotator string, origin string, label string, voted_s long, mutation_types array<string>"


@pytest.fixture(scope="module")
def found(spark):
    pairs = [
        (1, 1, "train", 0.9, "SAME_STORY", 10, 11, "Paris talks end", "paris talks begin"),
        (2, 2, "dev", 0.5, "DISTINCT", 20, 20, "same words", "same words"),
        (3, None, "test", float("nan"), "EVOLVED", 30, 31, "a b", None),
        (4, 4, None, 1.5, "NONE", 40, 41, " ", "Berlin"),
        (5, 5, "train", -0.2, "SAME_STORY", 50, 51, "x", "y"),
    ]
    votes = [
        (1, "user:2", "HUMAN", "SAME_STORY", 5, ["B", "A"]),
        (1, "user:1", "HUMAN", "SAME_STORY", 9, ["A", "B", "B"]),
        (1, "auto", "WEAK", "DISTINCT", 1, None),
        (2, "user:1", "HUMAN", "DISTINCT", 1, None),
        (2, "user:2", "HUMAN", "SAME_STORY", 1, None),
        (3, "user:1", "HUMAN", "EVOLVED", 1, ["A"]),
        (3, "user:2", "HUMAN", "EVOLVED", 1, ["C"]),
        (5, "auto", "WEAK", "SAME_STORY", 1, None),
        (99, "user:1", "HUMAN", "EVOLVED", 1, None),
    ]
    return records.pair_records(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(votes, VOTES))


def test_records_have_votes_features_and_reasons(found):
    rows = {r["pair_id"]: r for r in found.collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    one = rows[1]
    assert [(v["origin"], v["annotator"]) for v in one["votes"]] == [("HUMAN", "user:1"), ("HUMAN", "user:2"), ("WEAK", "auto")]
    assert (one["n_human"], one["n_votes"], one["consensus"], one["mutation_status"], one["mutation_types"]) == (2, 3, "SAME_STORY", "agreed", "A,B")
    assert one["lexical_jaccard"] == pytest.approx(2 / 4) and rows[2]["lexical_jaccard"] == 1.0 and rows[3]["lexical_jaccard"] is None
    assert rows[2]["entity_jaccard"] is None and rows[4]["entity_jaccard"] == 0.0
    assert rows[3]["mutation_status"] == "disagreement" and rows[4]["votes"] == [] and rows[5]["n_human"] == 0
    assert {k: r["excluded"] for k, r in rows.items()} == {1: None, 2: "disagreement", 3: "unassigned_event_or_split", 4: "needs_human_votes", 5: "needs_human_votes"}


def test_exclusions_add_up(found):
    assert {r["reason"]: r["records"] for r in records.exclusions(found).collect()} == {"selected": 1, "disagreement": 1, "unassigned_event_or_split": 1, "needs_human_votes": 2}


def test_invalid_records_name_every_broken_rule(found):
    assert {r["pair_id"]: r["reasons"].split(",") for r in records.invalid_records(found).collect()} == {
        2: ["self_pair", "consensus"],
        3: ["event_or_split", "text", "score"],
        4: ["event_or_split", "text", "score", "gold", "human_votes", "consensus"],
        5: ["human_votes", "consensus"],
    }


def test_records_of_empty_tables(spark):
    none = records.pair_records(spark.createDataFrame([], PAIRS), spark.createDataFrame([], VOTES))
    assert none.count() == 0 and records.exclusions(none).count() == 0 and records.invalid_records(none).count() == 0


def test_whole_changes_by_hand(spark):
    rows = [
        (1, 2, "Ten people met in Oslo.", "Ten people met in Oslo.", 100, 100),
        (3, 4, "The court heard 12 cases in the spring session of this long year", "The court heard 15 cases in the spring session of this long year", 100, 160),
        (5, 6, "all quiet here", "nothing like that over there today", 300, 200),
        (7, 8, "über die Brücke gingen viele", "über die Brücke liefen viele", None, 1),
        (9, 10, None, "", 1, 2),
    ]
    found = {r["from_id"]: r for r in changes.whole_changes(spark.createDataFrame(rows, "from_id long, to_id long, a string, b string, older_s long, newer_s long")).collect()}
    assert {k: (r["temporal_order"], r["lag_s"]) for k, r in found.items()} == {1: ("equal", 0), 3: ("strictly_older", 60), 5: ("reversed", -100), 7: ("unknown", None), 9: ("strictly_older", 1)}
    assert found[1]["types"] == found[9]["types"] == "NEAR_DUPLICATE" and not found[1]["meaningful"]
    assert found[3]["types"] == "NUMERIC_DRIFT" and found[3]["ratio"] > 0.9
    assert found[5]["types"].endswith("FRAMING_SHIFT") and found[7]["types"] == "WORDING_DRIFT"
    (span,) = json.loads(found[7]["changed_spans"])
    assert rows[3][2][slice(*span["older"])] == "gingen" and rows[3][3][slice(*span["newer"])] == "liefen"


def test_whole_changes_of_relations(spark):
    """Ratios equal those of the standard library's matcher; types follow from ratio, spans and kinds."""
    sf = "/root/testdata/sf0.001"
    found = catalog.QUERIES["pl_5_whole_changes"](spark, sf).collect()
    texts = {r["claim_id"]: r["claim_text"] for r in catalog.domain.claims(spark, sf).select("claim_id", "claim_text").collect()}
    known = {(r["from_id"], r["to_id"]): r for r in catalog.relation_changes(spark, sf).select("from_id", "to_id", "types", F.col("meaningful")).collect()}
    assert len(found) == len(known) > 100
    style = ("FRAMING_SHIFT", "WORDING_DRIFT", "NEAR_DUPLICATE")
    for r in found[:150]:
        a, b = ([m.group().lower() for m in re.finditer(TOKEN, texts[r[k]])] for k in ("to_id", "from_id"))
        assert r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())
        other = known[r["from_id"], r["to_id"]]
        assert r["meaningful"] == other["meaningful"] == (a != b)
        assert [t for t in r["types"].split(",") if t not in style] == [t for t in other["types"].split(",") if t not in style]


def test_near_pairs_at_the_very_limit(spark):
    """55 of 100 words: the product 100 * .55 exceeds 55 in floating point, the pair still counts."""
    words = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words), 0), (2, " ".join(words[:55]), 1), (3, " ".join(words[:54]), 2)], "id long, text string, at_s long")
    found = {(r["a"], r["b"]): r["jaccard"] for r in neardup.near_pairs(docs, 0.55, width=1).collect()}
    assert found == {(1, 2): pytest.approx(0.55), (2, 3): pytest.approx(54 / 55)}


def test_collection_summary(spark):
    rows = [("a", "u1", 1), ("a", "u2", 5), ("b", "u1", 2), ("b", "u3", 3), ("b", None, 4), ("c", "u2", 0), ("d", "u1", 9)]
    failures = [("c", "Timeout:\n  host \t away"), ("c", "Zeta"), ("e", "x" * 300)]
    found = aggregates.collection_summary(spark.createDataFrame(rows, "source string, url string, id long"), spark.createDataFrame(failures, "source string, error string"))
    rows = {r["source"]: tuple(r)[1:] for r in found.collect()}
    assert rows == {"a": (2, 2, None), "b": (3, 1, None), "c": (0, 0, "Failed - Timeout: host away"), "d": (1, 0, None), "e": (0, 0, "Failed - " + "x" * 200)}


def test_display_text_resolves_entities(spark):
    given = ["<p>Caf&eacute; &amp; bar</p>\n<b>now", "a <b>c</b> &#x4e2d;", "<div></div>", "", None, "5 < 6 &lt;b&gt;", "x" * 300]
    want = ["Café & bar now", "a c 中", None, None, None, "5 6 <b>", "x" * 200]
    found = spark.createDataFrame(list(enumerate(given)), "k long, html string").select("k", spans.display_text(200)("html").alias("shown"))
    assert [r["shown"] for r in found.orderBy("k").collect()] == want


def test_whole_preprocess(spark):
    """Every article once; what it shares with the plainer query is equal, times are those of the repair."""
    sf = "/root/testdata/sf0.001"
    found = {r["article_id"]: r for r in catalog.QUERIES["pl_1_whole_preprocess"](spark, sf).collect()}
    plain = {r["article_id"]: r for r in catalog.QUERIES["pl_1_preprocess"](spark, sf).collect()}
    times = {r["event_id"]: r["published_s"] for r in catalog.QUERIES["fn_7_published_repair"](spark, sf).collect()}
    assert set(found) == set(plain) and len(found) > 50
    for k, r in found.items():
        assert (r["domain"], r["canonical_id"], r["published_s"]) == (plain[k]["domain"], plain[k]["canonical_id"], times.get(k))
        assert r["n_words"] == (len(r["cleaned"].split()) if r["cleaned"] and r["cleaned"].split() else None)


def test_short_and_long_sequences_align_alike():
    rng = np.random.default_rng(5)
    for k in range(300):
        a, b = (rng.integers(0, 2 + k % 9, rng.integers(0, 40)) for _ in range(2))
        short, long = (changes.common_runs(a, b, limit) for limit in (10**6, -1))
        merged = []
        for i, j, n in long:  # the library joins runs that touch on both sides
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
            else:
                merged.append((i, j, n))
        assert short == merged
