"""Written times, whole texts, spans and the checks of evaluation records, against hand values."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import spans
from newsloom.functions import text as tx
from newsloom.operators import datasets

TIMES = [
    (None, '{"created_utc": 1700000000}', 1700000000),
    (None, '{"created_utc": 1700000000.9}', 1700000000),
    (None, '{"publishedAt": "2026-05-01"}', 1777593600),
    (None, '{"publishedAt": "2026-05-01T10:00:00Z"}', 1777629600),
    (None, '{"publishedAt": "2026-05-01T10:00:00.250+02:00"}', 1777622400),
    (None, '{"publishedAt": "2026-05-01T10:00:00+0200"}', 1777622400),
    (None, '{"publishedAt": "2026-05-01 10:00:00 -01:00"}', 1777633200),
    (None, '{"publishedAt": "2026-05-01 10:00"}', 1777629600),
    (None, '{"pubDate": "Fri, 01 May 2026 10:00:00 GMT"}', 1777629600),
    (None, '{"pubDate": "1 May 2026 10:00:00 +0530"}', 1777609800),
    (None, '{"pubDate": "Fri, 1 May 2026 10:00 UT"}', 1777629600),
    (None, '{"date": "May 1, 2026"}', 1777593600),
    (None, '{"date": "2026/05/01"}', 1777593600),
    (None, '{"date": "2026/05/01 10:00:00"}', 1777629600),
    (None, '{"published": "soon", "publishedAt": "", "date": "2026-05-01"}', 1777593600),
    (None, '{"publishedAt": null, "created_utc": 0, "pubDate": "never"}', None),
    (None, '{"date": "17"}', None),
    (None, '{"date": "2026-13-45"}', None),
    (None, '{"other": "2026-05-01"}', None),
    (None, "no json", None),
    (None, "[1]", None),
    (None, None, None),
    (5, '{"created_utc": 1700000000}', 5),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_published_times_are_repaired(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(k, known, payload) for k, (known, payload, _) in enumerate(TIMES)], "k int, known long, payload string")
        found = {r["k"]: r["t"] for r in rows.select("k", tx.repaired_time(F.col("known"), F.col("payload")).alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {TIMES[k][1]: t for k, t in found.items() if t != TIMES[k][2]} == {}


TEXTS = {
    "Cost rose to €1,200.50, up 5 % — don’t ask!": ["Cost", "rose", "to", "€1,200.50", ",", "up", "5 %", "—", "don’t", "ask", "!"],
    "Ünïted 😀 Nations −3k x_1 Straße's": ["Ünïted", "😀", "Nations", "−3k", "x", "_1", "Straße's"],
    "漢字 and ½": ["漢字", "and", "½"],
    "": [],
    "   ": [],
}


def test_tokens_carry_their_places(spark):
    spans.register(spark)
    texts = [*TEXTS, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    by_frame = sorted(tuple(r) for r in spans.token_spans(rows, "text").select("id", "position", "token", "start", "end").collect())
    by_sql = sorted(tuple(r) for r in spark.sql("SELECT id, t.* FROM {rows}, LATERAL text_tokens(text) t", rows=rows).collect())
    assert by_frame == by_sql
    for k, text in enumerate(texts):
        own = [r for r in by_frame if r[0] == k]
        assert [r[2] for r in own] == TEXTS.get(text, []) and [r[1] for r in own] == list(range(1, len(own) + 1))
        assert all(text[r[3] : r[4]] == r[2] for r in own)


def test_entities_carry_their_places(spark):
    text = "😀 In 2024 Jane Doe paid $1,500.25 (up 12.5%) to Acme Corp Ltd"
    found = {(r["entity_type"], r["entity_text"], r["start"], r["end"]) for r in spans.entity_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "claim_id long, claim_text string")).collect()}
    assert {f[:2] for f in found} == {("DATE", "2024"), ("NAME", "Jane Doe"), ("MONEY", "$1,500.25"), ("PERCENT", "12.5%"), ("NAME", "Acme Corp Ltd")}
    assert all(text[s:e] == t for _, t, s, e in found)


def test_markup_becomes_plain_text(spark):
    cases = {
        "<p>This is   some <b>messy</b> text&amp;more.</p>\n\n  \n<br>Yes.": "This is some messy text&more.\nYes.",
        "caf&eacute; &#x2014; &frac12;&nbsp;x &lt;b&gt;": "café — 1⁄2 x <b>",
        "<script>var x = 1 < 2;</script>ﬁne<style>p{}</style> ①<!-- no -->": "fine 1",
        "   ": "",
        "": None,
        "no tags": "no tags",
    }
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([*cases, None])], "id int, t string")
    found = {r["id"]: r["c"] for r in rows.select("id", spans.clean_text("t").alias("c")).collect()}
    assert found == {**dict(enumerate(cases.values())), len(cases): None}


def test_identity_of_texts(spark):
    texts = ["Straße  ﬁne", "STRASSE fine ", "strasse fine!", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = [r["k"] for r in rows.orderBy("id").select(spans.identity_key(0)("t").alias("k")).collect()]
    assert found[0] == found[1] != found[2] and found[3] is None and found[4] is not None
    assert [r["k"] for r in rows.orderBy("id").select(spans.identity_key(13)("t").alias("k")).collect()][:3] == [None, None, found[2]]


# ---------------------------------------------------------------- records

COLUMNS = "pair_id long, event_id string, split string, gold int, dataset_version string, claim_a_id long, claim_b_id long, article_a_id long, article_b_id long, canonical_a_id long, canonical_b_id long, hash_a string, hash_b string, text_key_a string, text_key_b string"


def record(pair, event, split, gold=1, claims=(None, None), articles=(None, None), canonical=(None, None), hashes=(None, None), texts=(None, None), version="v1"):
    return (pair, event, split, gold, version, *claims, *articles, *canonical, *hashes, *texts)


def problems(df):
    return sorted((r["problem"], r["subject"], r["n"]) for r in df.collect())


def good(spark, extra=()):
    rows = [record(k, f"e{k}", s, k % 2, (100 + k, 200 + k)) for k, s in enumerate(["train"] * 4 + ["test"] * 4)]
    return spark.createDataFrame([*rows, *extra], COLUMNS)


def test_a_leak_over_two_hops(spark):
    """Pairs 10 and 12 share nothing: 11 has an article of the one and the text of the other."""
    extra = [record(10, "x", "train", 1, (1, 2), (70, 71)), record(11, "y", "train", 0, (3, 4), (None, None), (71, None), texts=("t", None)), record(12, "z", "test", 1, (5, 6), texts=(None, "t"))]
    votes = spark.createDataFrame([("v1",), ("v2",)], "vote_id string")
    assert problems(datasets.validate_dataset(good(spark), votes, ["train", "test"])) == []
    assert problems(datasets.validate_dataset(good(spark, extra), votes, ["train", "test"])) == [("leakage", "10", 2)]
    groups = {r["pair_id"]: r["component"] for r in datasets.record_groups(good(spark, extra)).collect()}
    assert groups[10] == groups[11] == groups[12] == 10 and groups[3] == 3


def test_every_problem_of_a_dataset_is_named(spark):
    extra = [record(7, "e7", "test", 1, (50, 51)), record(20, "q", "train", 1, (51, 50), version="v2"), record(21, "unassigned", "test", 0), record(22, "unassigned", "train", 0)]
    votes = spark.createDataFrame([("v1",), ("v2",), ("v1",), (None,)], "vote_id string")
    found = problems(datasets.validate_dataset(good(spark, extra), votes, ["train", "dev", "test"]))
    assert found == [("leakage", "7", 2), ("repeated pair", "7", 2), ("repeated vote", "v1", 2), ("same claims", "50:51", 2), ("support", "dev", 0), ("versions", "dataset_version", 2)]
    empty = problems(datasets.validate_dataset(good(spark).limit(0), votes.limit(0), ["train"]))
    assert empty == [("no records", "", 0), ("support", "train", 0)]


def test_assignments(spark):
    u = datasets.UNASSIGNED
    rows = [record(1, u, u, claims=(1, 2)), record(2, u, u, claims=(2, 3)), record(3, u, u, claims=(8, 9)), record(4, "e", "train", claims=(20, 21)), record(5, u, u, claims=(21, 22)), record(6, u, u, claims=(40, 41)), record(7, "f", "dev", claims=(50, 51))]
    base = spark.createDataFrame(rows, COLUMNS)
    changes = lambda *c: spark.createDataFrame(list(c), "pair_id long, split string, event_id string")
    run = lambda *c: problems(datasets.validate_assignments(base, changes(*c)))
    assert run((3, "dev", "n"), (7, "dev", "f")) == []
    assert run((1, "train", "m"), (2, "train", "m")) == []
    assert run((1, "train", "m")) == [("assigned in part", "1", 1)]
    assert run((1, "train", "m"), (2, "test", "m")) == [("crosses", "1", 2)]
    assert run((5, "train", "g")) == [("crosses", "4", 2)]
    assert run((5, "train", "e")) == []
    assert run((4, "test", "e"), (7, "dev", "h"), (99, "dev", "e")) == [("assigned in part", "4", 1), ("frozen", "4", 1), ("frozen", "7", 1), ("unknown pair", "99", 1)]
    assert run((6, "dev", "a"), (6, "dev", "b")) == [("assigned in part", "6", 1), ("assigned twice", "6", 2)]


# ---------------------------------------------------------------- feed and groups


def test_feed_filters_and_tallies(spark):
    from newsloom.operators import alerts

    rows = [("SPIKE", "WARNING", "a", 5, None), ("SPIKE", "INFO", "b", 9, None), ("MUTATION", "WARNING", "c", 7, 8), ("MUTATION", "WARNING", "d", None, None)]
    frame = spark.createDataFrame(rows, "kind string, severity string, subject_key string, last_seen_s long, acknowledged_s long")
    keys = lambda df: [r["subject_key"] for r in df.collect()]
    assert keys(alerts.feed(frame, 10)) == ["b", "a", "d"] and keys(alerts.feed(frame, 1)) == ["b"]
    assert keys(alerts.feed(frame, 10, severity=" warning ")) == ["a", "d"] and keys(alerts.feed(frame, 10, "mutation", include_acknowledged=True)) == ["c", "d"]
    assert {(r["part"], r["name"], r["n"]) for r in alerts.tallies(frame).collect()} == {("all", "unacknowledged", 3), ("severity", "WARNING", 2), ("severity", "INFO", 1), ("kind", "SPIKE", 2), ("kind", "MUTATION", 1)}


def test_names_of_syndication_groups(spark):
    from newsloom.operators import graph

    rows = [(1, None, "h1", None), (2, 9, "h1", None), (3, None, None, "b"), (4, None, "h4", "b"), (5, None, None, None), (6, 5, None, None), (7, None, None, None)]
    found = {r["article_id"]: (r["component"], r["name"]) for r in graph.syndication_groups(spark.createDataFrame(rows, "article_id long, canonical_id long, content_hash string, body string")).collect()}
    assert found == {1: (1, "canonical:9"), 2: (1, "canonical:9"), 3: (3, "content:h4"), 4: (3, "content:h4"), 5: (5, "canonical:5"), 6: (5, "canonical:5"), 7: (7, "article:7")}


def test_edges_around_chosen_nodes(spark):
    from newsloom.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 2), (7, 8)], "a long, b long")
    assert sorted(tuple(r) for r in graph.around(edges, spark.createDataFrame([(2,)], "node long")).collect()) == [(1, 2), (1, 5), (2, 3), (5, 2)]


def test_sentences_keep_digits_at_their_ends(spark):
    """A sentence that begins or ends with the number of its place keeps it; blanks of any kind go from both ends."""
    said = ["0997523947200283 was paid to the office in May.", "1 in 11 of the people said so to the paper today 1", "\u00a022 houses burnt down in the old town on Monday.\u3000"]
    text = said[0] + " " + said[1] + "! " + said[2]
    got = spark.createDataFrame([(text,)], "t string").select(tx.sentences(F.col("t"))).first()[0]
    assert got == [said[0], said[1] + "!", said[2].strip()]
    many = [f"{k} and more words than thirty letters hold come at place {k}" for k in range(12)]
    got = spark.createDataFrame([("\u2003.  ".join(many),)], "t string").select(tx.sentences(F.col("t"), 12)).first()[0]
    assert got == [f"{m}\u2003." for m in many[:-1]] + many[-1:]


def test_entity_rows_end_words_like_their_positions(spark):
    """A year beside a letter outside ASCII is one in columns too, as it is by position; beside an ASCII letter it is not."""
    from newsloom.operators import features, verdicts

    rows = spark.createDataFrame([(1, "\u00e92019 and 1987\u00df, Vienna2001 x2020 2020x 2021_ 1999."), (2, None)], "claim_id long, claim_text string")
    got = sorted(r["entity_text"] for r in verdicts.entity_rows(rows).where("entity_type = 'DATE'").collect())
    assert got == sorted(r["entity_text"] for r in spans.entity_spans(rows).where("entity_type = 'DATE'").collect()) == ["1987", "1999", "2019"]
    assert {"2019", "1987"} <= set(rows.where("claim_id = 1").select(features.entity_set(F.col("claim_text"))).first()[0])


def test_a_vertical_tab_is_no_white_space(spark):
    """Sentences end, words are counted and tokens are cut at the white space that SQL knows: a vertical tab is a sign."""
    text = "One of them was at the office.\x0bAnd two of them were at home.\fThe others, at\x0bleast five of them, were late."
    row = spark.createDataFrame([(text,)], "t string").select(
        tx.sentences(F.col("t")).alias("s"), tx.tokens(F.lit("at\x0bleast 5")).alias("k"), tx.surface_tokens(F.lit("A\x0bB")).alias("u"), tx.claim_worthiness(F.lit("a b c d e f g h i\x0bj")).alias("w")
    ).first()
    assert row["s"] == ["One of them was at the office.\x0bAnd two of them were at home.", "The others, at\x0bleast five of them, were late."]
    assert row["k"] == ["at", "\x0b", "least", "5"] and row["u"] == ["A", "\x0b", "B"] and row["w"] == 0.5


def test_lower_case_goes_sign_by_sign(spark):
    """A dotted capital I becomes one sign and a sigma at a word's end the same as within it; weak labels read such texts."""
    said = spark.createDataFrame([("İT ΟΔΟΣ Äẞ",), (None,)], "t string")
    assert [r["x"] for r in said.select(tx.lower(F.col("t")).alias("x")).collect()] == ["it οδοσ äß", None]
    assert said.select(tx.token_set(F.col("t")).alias("x")).first()["x"] == ["it"]


def test_tokens_end_where_sql_ends_them(spark):
    """White space and the end after a magnitude are ASCII's: other blanks are signs, and no blank of a number."""
    rows = spark.createDataFrame([(1, "5kä 5k, 5kb 7%"), (2, "5\xa0% $\xa05"), (3, "a\x0bb\tc")], "id int, text string")
    got = {k: [r["token"] for r in spans.token_spans(rows.where(f"id = {k}"), "text").orderBy("position").collect()] for k in (1, 2, 3)}
    assert got == {1: ["5k", "ä", "5k", ",", "5", "kb", "7%"], 2: ["5", "\xa0", "%", "$", "\xa0", "5"], 3: ["a", "\x0b", "b", "c"]}
