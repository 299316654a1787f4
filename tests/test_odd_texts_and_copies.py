"""Queries against their SQL on tables whose texts are odd or come many times."""

import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import neardup, vectors
from newsloom.plans import catalog, intake
from newsloom.streaming import keyed

assert intake  # its queries are in the catalogue's table
TEXTS = [None, "", "  ", "\n", '"', 'a"\x00b', '\x00"', "\x01 a \x01", "a\x0bb", "\x0ba", "\u3000a\xa0", " a\u2003", "a\r\nb", "\\", '\\"\n\x00', "plain words", "#a,b"]


def tables(spark, folder, texts, sources=("news", None), days=None):
    """documents and events of the given texts; days: when each was collected."""
    rows = [(k, t, "en", sources[k % len(sources)], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    times = spark.createDataFrame([(k, float(k if days is None else days[k])) for k in range(len(texts))], "event_id long, d double")
    stamp = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, d * 86400) as ts"
    times.selectExpr("event_id", stamp, "1L as user_id", "'view' as event_type", "0.0D as value", "'{}' as props").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(folder, name):
    con = duckdb.connect()
    for table in ("documents", "events"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return con.execute(catalog.ORACLE_SQL[name]).fetchall()


def test_article_csv_keeps_every_sign(spark, tmp_path):
    """Signs at the ends, NUL beside quotes, vertical tabs, empty and absent contents and sources come out as in SQL."""
    folder = tables(spark, tmp_path, TEXTS)
    found = [tuple(r) for r in catalog.QUERIES["src_4_article_csv"](spark, folder).select("kind", "key", "value", "n").collect()]
    assert sorted(found, key=str) == sorted(by_sql(folder, "src_4_article_csv"), key=str)


def test_copies_link_by_each_of_their_times(spark, tmp_path):
    """A text is near another if any of its copies was collected within 14 days of any of the other's, not the first alone."""
    made = random.Random(8)
    base = [f"w{k}" for k in range(40)]
    kinds = [" ".join(made.choice("abc") if made.random() < 0.03 else w for w in base) for _ in range(12)] + ["", None, "a b", " ".join(base[::-1])]
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1])] + [made.choice(kinds) for _ in range(60)]
    days = [0, 20, 34] + [made.choice([0, 13.9, 14, 14.1, 27, 28, 42, 100, 114, made.uniform(0, 200)]) for _ in range(60)]
    folder = tables(spark, tmp_path, texts, days=days)
    found = {r["id"]: r["canonical_id"] for r in catalog.QUERIES["jn_10_near_duplicates"](spark, folder).collect()}
    assert found == dict(by_sql(folder, "jn_10_near_duplicates")) and found[2] == 0


def test_near_pairs_of_many_sizes_are_those_of_brute_force(spark):
    """Common shingles, sets of very different sizes, and thresholds high and low: no pair is lost to the prefixes or the parity bits."""
    made = random.Random(4)
    seeds = [[f"w{made.randrange(400)}" for _ in range(made.choice([3, 8, 20, 90, 400]))] for _ in range(25)]
    rows = []
    for k in range(110):
        words = [w if made.random() < made.choice([0.9, 0.99]) else f"x{made.randrange(9)}" for w in made.choice(seeds)]
        rows.append((k, " ".join(words[made.randrange(2) :] + ["the", "same", "last", "words"]), 0))
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t, _ in rows}
    docs = spark.createDataFrame(rows, "id long, text string, at_s long")
    for threshold in (0.75, 0.3):
        want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) * 1000 >= round(threshold * 1000) * len(sets[i] | sets[j])}
        assert len(want) > 20 and {(r["a"], r["b"]) for r in neardup.near_pairs(docs, threshold, block_rows=30).collect()} == want


def test_shingles_are_those_of_the_words(spark):
    made = random.Random(2)
    texts = ["".join(made.choice(["a", "bb", "é", " ", "  ", "\n", "\x0b", "x1", "\xa0"]) for _ in range(made.randrange(60))) for _ in range(200)] + [None, "", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r["id"]: r["s"] for r in neardup.shingle_rows(docs, 3, ()).collect()}
    words = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    want = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in enumerate(words) if len(w) > 2}
    assert {k: len(s) for k, s in found.items()} == {k: len(s) for k, s in want.items()}
    names = {}
    for k, s in want.items():
        for x in s:
            names.setdefault(x, set(found[k])).intersection_update(found[k])
    assert all(names.values()) and all(s == sorted(s, key=lambda x: x % 2**64) for s in found.values())


def test_texts_are_cut_once_for_all_languages(spark):
    """The plan names the split and the mark-up's removal once, though several of its parts use them."""
    docs = spark.createDataFrame([("the cat is on the mat and it is in the house",)], "t string")
    named = docs.select(text.language_by_words(F.col("t")).alias("lang"), text.word_count(text.clean_markup(F.col("t"))).alias("n"))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("<[^>]*>") == 1
    assert tuple(named.first()) == ("en", 12)


def test_candidates_are_cut_before_titles_join_them(spark):
    """Slots and blocks give a child more candidates than count; only its best are staged and meet what is said."""
    rows = [(1, 0, 70 - k, [1.0, k / 40]) for k in range(60)] + [(1, 10, 70, [1.0, 0.0])]
    table = spark.createDataFrame([(i * 100 + k, str(t), when, v) for k, (t, i, when, v) in enumerate(rows)], "id long, topic string, published_s long, v array<float>")
    found = vectors.earlier_candidates(table, 35, 0.2, 7, most=50)
    own = {r["parent"]: r["score"] for r in found.where("child = 1060").collect()}
    assert len(own) == 35 and all(abs(s - 1 / math.sqrt(1 + (p / 40) ** 2)) < 1e-6 for p, s in own.items())
    best = vectors.best_candidates(found, 4)
    assert [(r["parent"], r["place"]) for r in best.where("child = 1060").orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert not {"said", "title"} & set(best.columns)
    said = spark.createDataFrame([(1060, "x")] + [(k, "x" if k < 3 else "y") for k in range(60)], "id long, said string")
    edges = vectors.mutation_edges(best, said, 0.3, 0.2).where("child = 1060").select("parent", "kind").orderBy("parent").collect()
    assert [tuple(r) for r in edges] == [(1, "SIMILAR_TO"), (2, "SIMILAR_TO"), (3, "EVOLVED_FROM"), (4, "SIMILAR_TO")]


def test_a_slot_is_not_repeated_for_small_blocks(spark):
    """5,000 rows of one topic and slot meet in one task; vectors are shuffled as they are given."""
    table = spark.range(5_000).selectExpr("id", "'t' as topic", "id % 50 as published_s", "array(1f, 2f) as v")
    plan = vectors.earlier_candidates(table, 1_000, 0.99, most=1)
    assert plan.count() == 4_900
    text_ = plan._jdf.queryExecution().executedPlan().toString()
    assert "cast(v" not in text_ and vectors.BLOCK_ROWS >= 15_000


def test_a_streams_batch_saves_what_it_changed(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    schema = "id long, at_s long, text string"
    landed = str(tmp_path / "landed")
    spark.createDataFrame([(1, 0, words), (2, 5, words)], schema).write.parquet(landed)
    pairs = keyed.near_duplicate_pairs(spark.readStream.schema(schema).parquet(landed), spark.read.parquet(landed), str(tmp_path / "job"))
    assert [tuple(r) for r in pairs.select("a", "b").collect()] == [(1, 2)]
    assert list((tmp_path / "job" / "state" / "state").rglob("*.changelog")) and not list((tmp_path / "job" / "state" / "state").rglob("1.zip"))
