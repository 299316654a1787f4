"""Registered queries over all their rows, against brute force that knows no SQL."""

import collections
import difflib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import changes, features, graph, neardup, ranking, vectors, verdicts
from newsloom.plans import catalog
from newsloom.plans.staging import meet
from newsloom.sources import domain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def near(spark):
    near = collections.defaultdict(set)
    for r in domain.article_edges(spark, SF).collect():
        near[r["a"]].add(r["b"])
        near[r["b"]].add(r["a"])
    return near


def hops(near, root, most):
    found, front = {root: 0}, {root}
    for hop in range(1, most + 1):
        front = {y for x in front for y in near[x]} - set(found)
        found |= dict.fromkeys(front, hop)
    return found


def test_every_article_is_a_root(spark, near):
    ids = {r["doc_id"] for r in domain.table(spark, SF, "documents").select("doc_id").collect()}
    want = {(root, node, hop) for root in ids for node, hop in hops(near, root, 3).items()}
    got = [tuple(r) for r in catalog.QUERIES["gr_3_within_three_hops"](spark, SF).select("root", "node", "hop").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    levels = {root: [h for h in hops(near, root, 3).values() if h] for root in ids}
    profile = {r["root"]: (r["reached"], r["expected"]) for r in catalog.QUERIES["gr_9_reach_profile"](spark, SF).collect()}
    assert profile == {root: (len(h), pytest.approx(sum(0.5**x for x in h), abs=1e-6)) for root, h in levels.items() if h}
    nodes = [r["node"] for r in catalog.QUERIES["set_1_root_and_neighbours"](spark, SF).collect()]
    assert len(nodes) == len(set(nodes)) and set(nodes) == ids | {y for x in near.values() for y in x}


def test_every_article_is_a_path_centre(spark, near):
    want = {(a, m, c) for m, ends in list(near.items()) for a in ends for c in ends if a < c}
    got = [tuple(r) for r in catalog.QUERIES["gr_13_two_hop_paths"](spark, SF).select("a", "m", "c").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_every_claim_has_a_lineage(spark):
    near = collections.defaultdict(set)
    for r in domain.relations(spark, SF).where("kind = 'EVOLVED_FROM'").collect():
        near[r["from_id"]].add(r["to_id"])
        near[r["to_id"]].add(r["from_id"])
    ids = [r["claim_id"] for r in domain.claims(spark, SF).select("claim_id").collect()]
    want = {(root, node, hop) for root in ids for node, hop in hops(near, root, 3).items()}
    got = [tuple(r) for r in catalog.QUERIES["gr_4_lineage_hops"](spark, SF).select("root", "node", "hop").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_every_distinct_edge_is_kept_once(spark):
    want = {(r["from_id"], r["to_id"], r["kind"]): max(r["score"], 1 - r["score"]) for r in domain.relations(spark, SF).collect()}
    got = catalog.QUERIES["win_1_edge_dedupe"](spark, SF).collect()
    assert len(got) == len(want) > 50 and {(r["from_id"], r["to_id"], r["kind"]): r["score"] for r in got} == want


def test_csv_cells_are_whole(spark):
    html = {r["page_id"]: r["html"] for r in domain.table(spark, SF, "pages").select("page_id", "html").collect()}
    got = catalog.QUERIES["snk_2_csv_safe_cells"](spark, SF).collect()
    assert len(got) == len(html) and max(len(r["cell"]) for r in got) > 41
    assert all(r["cell"] == ("'" if html[r["page_id"]][:1] in tuple("=+-@\t\r") else "") + html[r["page_id"]] for r in got)


def test_ngrams_of_three_to_five_stay_inside_words(spark):
    rows = spark.createDataFrame([(1, "Abc  de"), (2, "a\tlong")], "id long, text string")
    got = features.ngram_tfidf(rows).groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("t")).collect()
    want = {1: [" ab", "abc", "bc ", " abc", "abc ", " abc ", " de", "de ", " de "], 2: [" a ", " lo", "lon", "ong", "ng ", " lon", "long", "ong ", " long", "long "]}
    assert {r["id"]: r["t"] for r in got} == {k: sorted(v) for k, v in want.items()}
    long_only = features.ngram_tfidf(rows, 4, 4).where("id = 2").select("term").collect()
    assert sorted(r["term"] for r in long_only) == sorted([" a ", " lon", "long", "ong "])


def test_scores_of_three_to_five_grams(spark):
    text = {r["item_id"]: r["text"].lower() for r in domain.table(spark, SF, "benchmark").select("item_id", "text").collect()}
    tf = {i: collections.Counter(f" {w} "[k : k + n] for w in t.split() for n in (3, 4, 5) for k in range(len(w) + 3 - n)) for i, t in text.items()}
    df = collections.Counter(x for c in tf.values() for x in c)
    w = {i: {x: (1 + math.log(k)) * (math.log((1 + len(text)) / (1 + df[x])) + 1) for x, k in c.items()} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(v * v for v in c.values())) for i, c in w.items()}
    dot = {(i, i + 1): sum(v * w[i + 1][x] for x, v in w[i].items() if x in w[i + 1]) / norm[i] / norm[i + 1] for i in w if i + 1 in w and set(w[i]) & set(w[i + 1])}
    got = {(r["a"], r["b"]): r["score"] for r in catalog.QUERIES["fn_20_ngram_tfidf"](spark, SF).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in dot.items()}


def test_capped_pairs_go_on_until_none_is_open_or_raise(spark):
    path = spark.createDataFrame([(i, i + 1, -float(i)) for i in range(9)], "a long, b long, score double")
    taken = ranking.capped_pairs(path, [F.desc("score"), "a", "b"], 1).collect()
    assert sorted(r["a"] for r in taken) == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        ranking.capped_pairs(path.where("a < 2"), [F.desc("score")], 0)


def passage_by_hand(body, claim, candidate):
    """The rule in plain Python."""
    if not body.strip():
        return candidate, "extracted_claim"
    spans = [m.span() for m in re.finditer(r"\S.*?(?:[.!?](?=\s|$)|\n|$)", body, re.DOTALL)]
    at = body.lower().find(candidate.lower()) if candidate else -1
    words = lambda t: set(re.findall(r"\w{3,}", t.lower()))
    if at >= 0:
        i = next((i for i, s in enumerate(spans) if s[1] > at), 0)
    else:
        i = max(range(len(spans)), key=lambda i: len(words(f"{candidate} {claim}") & words(body[slice(*spans[i])])))
    start, end = spans[i]
    if end - start > 1000:
        start = max(start, at - 200) if at >= 0 else start
        end = min(len(body), start + 1000)
    else:
        if i and end - spans[i - 1][0] <= 1000:
            start = spans[i - 1][0]
        if i + 1 < len(spans) and spans[i + 1][1] - start <= 1000:
            end = spans[i + 1][1]
    return body[start:end].strip(), "content"


def test_passages_come_from_the_whole_body(spark):
    many = "  ".join(f"Sentence number {i} speaks of nothing at all here." for i in range(12)) + " Short proof.\nThe harbour bridge was closed on Monday! Is it? Yes."
    long = "Start here. " + "word " * 300 + "the secret anchor stands here " + "more " * 300 + "end. Last one."
    bodies = {1: many, 2: long, 3: " \n ", 4: "One. " + "b" * 995 + ". Three.", 5: "Ein Wort: Größe zählt.\n\nZweite Zeile ohne Ende"}
    asked = [(1, "was the harbour bridge closed", 1, "unseen words"), (2, "x", 1, "SHORT PROOF."), (3, "x", 2, "Secret Anchor"), (4, "more", 2, ""), (5, "x", 3, "told"), (6, "Three", 4, ""), (7, "größe", 5, ""), (8, "none", 5, "zeile ohne"), (9, "nothing", 1, "")]
    pairs = spark.createDataFrame(asked, "claim_id long, claim_text string, article_id long, candidate string")
    articles = spark.createDataFrame(list(bodies.items()), "article_id long, content string")
    got = {r["claim_id"]: (r["passage"], r["source"]) for r in verdicts.body_passage(pairs, articles).collect()}
    assert got == {i: passage_by_hand(bodies[a], claim, cand) for i, claim, a, cand in asked}
    assert "harbour bridge" in got[1][0]


def test_every_claim_has_a_passage(spark):
    body = {r["article_id"]: r["content"] for r in domain.articles(spark, SF).select("article_id", "content").collect()}
    want = {r["claim_id"]: passage_by_hand(body[r["article_id"]], r["claim_text"], r["claim_text"]) for r in domain.claims(spark, SF).collect()}
    got = catalog.QUERIES["pl_8_body_passage"](spark, SF).collect()
    assert len(got) == len(want) and {r["claim_id"]: (r["passage"], r["source"]) for r in got} == want


def test_hot_keys_meet_in_blocks(spark):
    left = spark.createDataFrame([(i, None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 5}") for i in range(120)], "l long, key string")
    right = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(90)] + [(1, "hot")], "r long, key string")
    plain = sorted((x["l"], x["r"]) for x in left.join(right, "key").collect())
    for block_rows in (1, 7, 4_000):
        assert sorted((x["l"], x["r"]) for x in meet(left, right, ["key"], "l", "r", block_rows).collect()) == plain
    assert meet(left.limit(0), right, ["key"], "l", "r").count() == 0


def test_candidates_and_duplicates_do_not_depend_on_the_block(spark):
    made = random.Random(5)
    rows = [(i, made.choice(["a", "a", "b", None]), made.choice([None, *range(0, 60, 3)]), [made.random() - 0.4 for _ in range(4)] if i % 11 else [0.0] * 4) for i in range(80)]
    vectors_ = spark.createDataFrame(rows, "id long, topic string, published_s long, v array<double>")
    expected = set()
    for i, topic, t, v in rows:
        for j, other, u, w in rows:
            if i != j and topic is not None and topic == other and t is not None and u is not None and t - 20 <= u < t:
                norm = math.sqrt(sum(x * x for x in v) * sum(x * x for x in w))
                if norm > 0 and sum(x * y for x, y in zip(v, w)) / norm >= 0.3:
                    expected.add((i, j))
    assert expected
    for block_rows in (2, 4_000):
        assert {(x["child"], x["parent"]) for x in vectors.earlier_candidates(vectors_, 20, 0.3, block_rows).collect()} == expected
    texts = [(i, " ".join(made.choice(["one", "two", "three"]) if made.random() < 0.03 else f"w{k}" for k in range(30)), i) for i in range(25)]
    articles = spark.createDataFrame(texts, "id long, text string, at_s long")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(28)} for i, t, _ in texts}
    close = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75}
    for block_rows in (3, 4_000):
        assert {(x["a"], x["b"]) for x in neardup.near_pairs(articles, block_rows=block_rows).collect()} == close


def test_hub_ranks_are_limited_before_the_shuffle(spark):
    edges = spark.createDataFrame([(1, k) for k in range(2, 30)], "a long, b long")
    articles = spark.createDataFrame([(k, None if k == 5 else 100 - k) for k in range(1, 30)], "article_id long, published_s long")
    race = ranking.scoop_race(edges=edges, articles=articles)
    assert [tuple(r) for r in race.orderBy("place").collect()] == [(1, 30 - p, p, p - 1, 28, 28) for p in range(1, 7)]
    for df in (race, graph.hub_timelines(edges, articles, 2, 3)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


def test_token_runs_agree_with_the_standard_library():
    made = random.Random(3)
    for _ in range(300):
        a, b = ([made.randrange(made.choice([2, 6])) for _ in range(made.randrange(25))] for _ in range(2))
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]
        mine = changes.common_runs(np.array(a, np.int64), np.array(b, np.int64))
        joined = []
        for i, j, n in mine:
            if joined and (joined[-1][0] + joined[-1][2], joined[-1][1] + joined[-1][2]) == (i, j):
                joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + n)
            else:
                joined.append((i, j, n))
        assert joined == [tuple(x) for x in blocks]


def test_texts_stay_where_they_are(spark, tmp_path):
    """No join of articles or claims with the events' times carries a text that the query does not read."""
    from newsloom.sources import domain

    spark.createDataFrame([(1, "A sentence that is long enough to be a claim.", "en", "src1", 45)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select 1L as event_id, timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")

    def carried(df):
        found, todo = set(), [df._jdf.queryExecution().optimizedPlan()]
        while todo:
            node = todo.pop()
            below = [node.children().apply(k) for k in range(node.children().size())]
            todo += below
            if node.nodeName() == "Join":
                found |= {c.output().apply(k).name() for c in below for k in range(c.output().size())}
        return found

    path = str(tmp_path)
    assert not {"text", "claim_text"} & carried(domain.relations(spark, path))
    assert not {"text", "content"} & carried(domain.articles(spark, path).select("article_id", "title", "content_hash", "collected_s"))
    assert "text" not in carried(domain.claims(spark, path))
    assert [tuple(r) for r in domain.claims(spark, path).select("claim_id", "extracted_s").collect()] == [(8, 1_704_067_200 + 3600)]


def test_tokens_are_cut_once_for_all_kinds_of_change(spark):
    from newsloom.operators import verdicts

    pairs = spark.createDataFrame([("It may not cost $5 in Paris.", "It cost $6 in Rome.")], "a string, b string")
    changed = verdicts.text_change(pairs)
    assert changed.first()["types"] == "NUMERIC_DRIFT,ENTITY_SUBSTITUTION,POLARITY_SHIFT,HEDGING_SHIFT,FRAMING_SHIFT"
    assert changed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 6


def test_only_rows_of_given_keys_by_either_way(spark):
    from newsloom.plans.staging import only

    big = spark.createDataFrame([(k % 5, f"t{k}") for k in range(20)], "id long, text string")
    some = spark.createDataFrame([(1,), (3,), (3,), (9,)], "id long")
    for limit in (10, 0):
        assert sorted(tuple(r) for r in only(big, some, "id", limit).collect()) == sorted((k % 5, f"t{k}") for k in range(20) if k % 5 in (1, 3))


def test_shingles_in_many_ways_make_the_same_pairs(spark):
    """Texts and times apart give what they give together; a shingle of one text alone links nothing."""
    from newsloom.operators import neardup

    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words), 0), (2, " ".join(words[:-1]), 60), (3, " ".join(words[::-1]), 90), (4, None, 5), (5, " ".join(words), None), (6, "w0 w1", 7), (7, " ".join(words), 30)]
    docs = spark.createDataFrame(rows, "id long, text string, at_s long")
    apart = neardup.near_duplicates(docs.select("id", "text"), times=docs.select("id", "at_s"))
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 1}
    assert {r[0]: r[1] for r in apart.collect()} == want == {r[0]: r[1] for r in neardup.near_duplicates(docs).collect()}
