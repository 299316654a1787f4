"""Feed readers on small files, and streams against their batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom.sources import domain, feeds
from newsloom.streaming import jobs, keyed


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_rss_items(spark, tmp_path):
    items = "".join(f"<item>{x}</item>" for x in ("<title>RSS 1</title><link>http://rss.com/1</link><description>one</description><pubDate>Tue, 14 Nov 2023 22:13:20 GMT</pubDate>", "<title> </title><link>http://rss.com/2</link>", "<title>RSS 3</title>"))
    rows = feeds.read_rss(spark, put(tmp_path, "feed.xml", f"<rss><channel>{items}</channel></rss>")).collect()
    assert [(r["title"], r["url"], r["content"]) for r in rows] == [("RSS 1", "http://rss.com/1", "one")]
    assert rows[0]["published_at"].year == 2023


def test_forum_posts(spark, tmp_path):
    posts = [{"title": "Post 1", "permalink": "/r/x/1", "url": "http://else", "created_utc": 1700000000, "subreddit": "r/news"}, {"title": None, "url": "u"}, {"title": "Post 2", "url": "http://two", "subreddit": "/r/x"}]
    rows = feeds.read_forum(spark, put(tmp_path, "list.json", json.dumps({"data": {"children": [{"data": p} for p in posts]}}))).orderBy("title").collect()
    assert [(r["url"], r["source"]) for r in rows] == [("https://www.reddit.com/r/x/1", "news"), ("http://two", "x")]


def test_news_articles(spark, tmp_path):
    news = {"status": "ok", "articles": [{"title": "News 1", "url": "u1", "description": "d", "publishedAt": "2026-05-01T10:00:00Z"}, {"title": "[Removed]"}, {"title": None}]}
    rows = feeds.read_news(spark, put(tmp_path, "news.json", json.dumps(news))).collect()
    assert [(r["title"], r["content"], r["published_at"].month) for r in rows] == [("News 1", "d", 5)]
    assert feeds.read_news(spark, put(tmp_path, "bad.json", json.dumps(news | {"status": "error"}))).count() == 0


def test_article_csv(spark, tmp_path):
    text = "url,source_url,source_name,source_type,title,word_count\n u1 ,s,S,rss,first,12\nu1,s,S,rss,second,3\n,s,S,rss,none,1\nu2,t,T,rss, ,1x\n"
    articles, sources = feeds.read_article_csv(spark, put(tmp_path, "a.csv", text))
    assert {(r["url"], r["title"], r["word_count"]) for r in articles.collect()} == {("u1", "first", 12), ("u2", None, None)}
    assert {r["source_url"] for r in sources.collect()} == {"s", "t"}


def test_records_and_export(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', '{"a": 1, "a": 2}', "[1]", "{bad", '{"a": 3, "b": "y"}']
    records, rejected = feeds.read_records(spark, put(tmp_path, "r.jsonl", "\n".join(lines)), "a int, b string")
    assert {tuple(r) for r in records.collect()} == {(1, "x"), (3, "y")} and rejected.count() == 3
    manifest = feeds.write_records(records, str(tmp_path / "out"), "a").first()
    assert manifest["n"] == 2
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()] == ['{"a":1,"b":"x"}', '{"a":3,"b":"y"}']
    with pytest.raises(Exception, match="(?i)exist"):
        feeds.write_records(records, str(tmp_path / "out"), "a")


def test_statements(spark, tmp_path):
    rows = feeds.read_statements_tsv(spark, put(tmp_path, "s.tsv", '1.json\ttrue\tHe said "no\n2.json\tfalse\tplain\n'))
    assert rows.orderBy("id").first()["statement"] == 'He said "no'


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    rows = domain.table(spark, "/root/testdata/sf0.001", "events").withColumn("url", F.concat(F.lit("u"), F.col("event_id") % 300))
    rows.repartition(3).write.mode("overwrite").parquet(folder)
    return folder, rows


def test_windowed_counts_equal_batch(spark, arrived):
    folder, rows = arrived
    stream = jobs.event_stream(spark, folder, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    found = jobs.drain(jobs.windowed_counts(stream, ["event_type"], "24 hours"), "complete", "counts")
    batch = rows.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "24 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert found.exceptAll(batch).isEmpty() and batch.exceptAll(found).isEmpty()
    surges = jobs.surges(batch, ["event_type"], 5)
    assert surges.where("n < 5 or n < 2 * prior").isEmpty()
    assert jobs.over_limit(batch, 10).where("n <= 10").isEmpty()


def test_first_by_url(spark, arrived):
    folder, rows = arrived
    stream = jobs.event_stream(spark, folder, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    found = jobs.drain(jobs.first_by_url(stream, "60 days").select("url", "ts"), "append", "urls")
    assert found.count() == found.select("url").distinct().count() == 300


def test_alert_registry_equals_batch(spark, arrived, tmp_path):
    folder, rows = arrived
    stream = jobs.event_stream(spark, folder, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    named = stream.select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("subject_key"), "ts")
    found = keyed.alert_registry(named, str(tmp_path)).select("kind", "subject_key", "first_s", "last_s")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    batch = rows.groupBy(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("subject_key")).agg(F.min(at).alias("first_s"), F.max(at).alias("last_s"))
    assert found.exceptAll(batch).isEmpty() and batch.exceptAll(found).isEmpty()


def _arrivals(spark, tmp_path, schema, batches, run):
    """run's table after each arrival; every call starts the stream anew with the same folder."""
    landed, folder = str(tmp_path / "landed"), str(tmp_path / "job")
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        out.append(sorted(tuple(r) for r in run(spark.readStream.schema(schema).parquet(landed), folder).collect()))
    return out


HOUR, DAY = 3_600, 86_400
ALERTS = "kind string, subject_key string, ts timestamp, acknowledge boolean"


def _at(seconds):
    from datetime import datetime, timezone

    return None if seconds is None else datetime.fromtimestamp(seconds, timezone.utc)


def test_alert_registry_survives_restarts(spark, tmp_path):
    first = [("A", "x", _at(2 * DAY), False), ("A", "x", _at(5 * DAY), False), ("C", "z", _at(9), True), ("D", "n", None, False)]
    second = [("A", "x", _at(DAY), False), ("B", "y", _at(3 * DAY), False), ("A", "x", _at(6 * DAY), True)]
    third = [("A", "x", _at(4 * DAY), True), ("C", "z", _at(DAY), None), ("A", "x", _at(7 * DAY), True)]
    found = _arrivals(spark, tmp_path, ALERTS, [first, second, third], keyed.alert_registry)
    assert found[0] == [("A", "x", 2 * DAY, 5 * DAY, None)]
    assert found[1] == [("A", "x", DAY, 5 * DAY, 6 * DAY), ("B", "y", 3 * DAY, 3 * DAY, None)]
    assert found[2] == [("A", "x", DAY, 5 * DAY, 4 * DAY), ("B", "y", 3 * DAY, 3 * DAY, None), ("C", "z", DAY, DAY, 9)]
    log = spark.read.parquet(str(tmp_path / "job" / "log"))
    assert sorted((r["batch"], r["kind"]) for r in log.select("batch", "kind").collect()) == [(0, "A"), (0, "C"), (1, "A"), (1, "B"), (2, "A"), (2, "C")]


def test_alerts_are_forgotten_and_start_anew(spark, tmp_path):
    batches = [[("A", "x", _at(DAY), False), ("B", "y", _at(DAY), False)], [("B", "y", _at(20 * DAY), False)], [("A", "x", _at(21 * DAY), False)]]
    found = _arrivals(spark, tmp_path, ALERTS, batches, lambda s, f: keyed.alert_registry(s, f, forget_s=10 * DAY))
    assert found[0] == [("A", "x", DAY, DAY, None), ("B", "y", DAY, DAY, None)]
    assert found[1] == [("B", "y", DAY, 20 * DAY, None)]
    assert found[2] == [("A", "x", 21 * DAY, 21 * DAY, None), ("B", "y", DAY, 20 * DAY, None)]


def test_streamed_near_duplicates_within_the_window(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    batches = [[(1, 0, text), (2, DAY, text + " end"), (8, None, text), (9, 0, None)], [(3, 3 * DAY, "start " + text), (4, 3 * DAY, "something else entirely here")], [(5, 30 * DAY, text), (3, 3 * DAY, "start " + text)], [(6, 31 * DAY, text)]]
    schema = "id long, at_s long, text string"
    run = lambda s, f: keyed.near_duplicate_pairs(s, spark.read.schema(schema).parquet(str(tmp_path / "landed")), f).select("a", "b")
    found = _arrivals(spark, tmp_path, schema, batches, run)
    assert found == [[(1, 2)], [(1, 2), (1, 3), (2, 3)], [(1, 2), (1, 3), (2, 3)], [(1, 2), (1, 3), (2, 3), (5, 6)]]
    landed = spark.read.schema(schema).parquet(str(tmp_path / "landed")).dropDuplicates(["id"])
    pairs = spark.createDataFrame(found[-1], "a long, b long")
    named = {r["id"]: r["canonical_id"] for r in keyed.canonical_articles(pairs, landed).collect()}
    assert named == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 8: 8, 9: 9}


def test_streamed_pairs_equal_those_of_all_at_once(spark, tmp_path):
    import random

    from newsloom.operators import neardup

    rng = random.Random(4)
    base = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=80)) for _ in range(12)]
    rows = []
    for k in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"x{rng.randrange(50)}"
        rows.append((k, k * DAY // 3, " ".join(words)))
    schema = "id long, at_s long, text string"
    run = lambda s, f: keyed.near_duplicate_pairs(s, spark.read.schema(schema).parquet(str(tmp_path / "landed")), f).select("a", "b")
    found = _arrivals(spark, tmp_path, schema, [rows[:30], rows[30:60], rows[60:]], run)[-1]
    want = sorted((r["a"], r["b"]) for r in neardup.near_pairs(spark.createDataFrame(rows, schema)).collect())
    assert found == want and len(want) > 20


def test_rows_behind_the_watermark_are_set_aside(spark, tmp_path):
    schema = "id long, ts timestamp"
    batches = [[(1, _at(10 * HOUR)), (2, None), (3, _at(900 * HOUR))], [(4, _at(8 * HOUR)), (5, _at(9 * HOUR)), (6, _at(20 * HOUR))], [(7, _at(18 * HOUR)), (8, _at(20 * HOUR)), (9, None), (10, _at(901 * HOUR))]]
    tables = []

    def run(stream, folder):
        usable, aside = keyed.arrivals(stream, folder, HOUR, "1970-02-01")
        tables.append(usable)
        return usable.select("id", F.lit("usable")).union(aside.select("id", "reason"))

    found = _arrivals(spark, tmp_path, schema, batches, run)
    assert [len(f) for f in found] == [3, 6, 10]
    assert found[-1] == [(1, "usable"), (2, "unknown time"), (3, "future time"), (4, "late"), (5, "usable"), (6, "usable"), (7, "late"), (8, "usable"), (9, "unknown time"), (10, "future time")]
    assert tables[-1].columns == ["id", "ts"]


def test_clustering_waits_for_rows_and_time(spark, tmp_path):
    batches = [[(i,) for i in range(6)], [(100 + i,) for i in range(6)], [(200 + i,) for i in range(20)], [(9000,)]]
    found = _arrivals(spark, tmp_path, "at_s long", batches, lambda s, f: jobs.clustering_runs(s, f, 10, 3600).na.fill(0))
    assert found == [[(-1, 0, 6)], [(-1, 0, 0), (0, 105, 12)], [(-1, 0, 20), (0, 105, 12)], [(-1, 0, 0), (0, 105, 12), (1, 9000, 21)]]


def test_benchmark_csv_readers(spark, tmp_path):
    scored, claims, records = (str(tmp_path / n) for n in ("a.csv", "b.csv", "c.jsonl"))
    open(scored, "w").write('Text,Verdict\n"one, ""two""",1\nthree,-1\nfour,\n')
    open(claims, "w").write("claimID,claim,label,x\n1,said,true,9\n2,,false,9\n3,more,,9\n")
    open(records, "w").write('{"id":1,"claim":"c","label":"L","evidence":[]}\n\n{"id":2}\n')
    assert [tuple(r) for r in feeds.read_scored_csv(spark, scored).collect()] == [('one, "two"', 1.0), ("three", 0.0), ("four", 0.0)]
    assert [tuple(r) for r in feeds.read_claims_csv(spark, claims).collect()] == [("1", "said", "true")]
    assert [tuple(r) for r in feeds.read_claim_records(spark, records).collect()] == [(1, "c", "L"), (2, None, None)]


def test_the_index_of_bands_is_the_state_of_a_join(spark, tmp_path):
    """The keys of bands, 22 for each article, go through no Python process one by one."""
    text = " ".join(f"w{i}" for i in range(60))
    schema = "id long, at_s long, text string"
    run = lambda s, f: keyed.near_duplicate_pairs(s, spark.read.schema(schema).parquet(str(tmp_path / "landed")), f).select("a", "b")
    found = _arrivals(spark, tmp_path, schema, [[(1, 0, text), (3, 0, text)], [(2, 14 * DAY, text), (4, 14 * DAY + 1, text)]], run)
    assert found[-1] == [(1, 2), (1, 3), (2, 4), (3, 2)]
    state = next(p.parent for p in tmp_path.rglob("offsets") if p.is_dir())
    assert {r["operatorName"] for r in spark.read.format("state-metadata").load(f"file://{state}").select("operatorName").collect()} == {"symmetricHashJoin"}
