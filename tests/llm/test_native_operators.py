"""Licence scan, quality rules, sharding and mixing against plain Python on small tables."""

import collections
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.llm import license_scan, mixing, quality_rules, sharding, text_columns
from newsloom.llm.license_texts import KNOWN_DIGESTS, KNOWN_TEXTS
from newsloom.plans.staging import attach

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, kept boolean, bucket string, n long, rows long"


def make(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, lang, src, 0, -1, -1, None, "x", -1, -1) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, long, "en", "b"), (5, "same text here", "en", "b"), (5, "same text here", "en", "b"), (None, "no id", "en", "c"), (7, None, None, None)]
    return make(spark, rows)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---------------------------------------------------------------- licences


def test_license_variants_match(spark):
    mit = KNOWN_TEXTS["MIT"]
    shouted = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace('"', "“").replace("SUBLICENSE", "sub-license") + "\n\nAll rights reserved."
    wrapped = re.sub(r"\s+", "\n   ", mit)
    near = mit.replace("free of charge", "for a fee")
    rows = make(spark, [(1, shouted, "en", "a"), (2, wrapped, "en", "a"), (3, near, "en", "a"), (4, KNOWN_TEXTS["ISC"] + " and more", "en", "a"), (5, KNOWN_TEXTS["Zlib"], None, None)])
    found = by_id(license_scan.scan_licenses(rows))
    assert [found[i]["license_id"] for i in range(1, 6)] == ["MIT", "MIT", None, None, "Zlib"]


def test_license_known_forms_differ(spark):
    assert license_scan.known_digests(spark).count() == len(KNOWN_TEXTS) + len(KNOWN_DIGESTS)


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="needs the long licences' texts")
@pytest.mark.parametrize(("file", "name"), [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_licenses_match_whole(spark, file, name):
    text = Path("/usr/share/common-licenses", file).read_text(encoding="utf-8")
    end = "END OF TERMS AND CONDITIONS"
    terms = text[: text.index(end) + len(end)] if end in text else text
    rows = make(spark, [(1, text, "en", "a"), (2, " ".join(text.replace("(C)", "(c)").splitlines(True)).upper(), "en", "a"), (3, terms, "en", "a"), (4, text[:-200], "en", "a"), (5, text + " Also.", "en", "a")])
    found = by_id(license_scan.scan_licenses(rows))
    assert [found[i]["license_id"] for i in range(1, 6)] == [name, name, f"{name} terms" if end in text else name, None, None]


def test_license_odd_rows(spark, odd):
    rows = license_scan.scan_licenses(odd).collect()
    assert len(rows) == 8 and not any(r["is_license"] for r in rows)
    found = {r["doc_id"]: r for r in rows}
    assert found[1]["text_digest"] is None
    assert found[2]["text_digest"] == found[3]["text_digest"]
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_license_table_of_the_callers(spark, odd):
    texts = spark.createDataFrame([("mine", "Same, TEXT here!"), ("also", "same text   here")], "license_id string, text string")
    assert by_id(license_scan.scan_licenses(odd, texts, max_known=0))[5]["license_id"] == "also"


# ---------------------------------------------------------------- quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd):
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z q x y z\nx y z q\nx y z q", "é ü # | <b>\x0b\x0c ß\r\n\r\n", "a b\n a b\na b\n\n\n", "a b c d a b c d a b"]
    rows = make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    found = by_id(quality_rules.document_counts(rows))
    for i, t in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(t), t
    long = by_id(quality_rules.document_counts(odd))[4]
    assert long["n_words"] == 30_000 and long["n_repeat_words"] == 30_000


def test_quality_buckets_are_ordered(spark):
    rows = spark.range(200_000).select("id", quality_rules.bucket_of(F.col("id")).alias("b"))
    rows = rows.withColumn("top", quality_rules.bucket_top(F.col("b")))
    assert rows.where("top < id or top > id + id / 32").count() == 0
    assert rows.groupBy("b").agg(F.max("id").alias("m"), F.min("top").alias("t")).where("m > t").count() == 0


def test_quality_limits_follow_the_group(spark):
    clean = [(i, " ".join(f"w{i:02d}x{k:02d}" for k in range(60)), "en", "a") for i in range(60)]
    noisy = [(100 + i, " ".join(f"w{i:02d}y{k:02d}##" for k in range(60)), "en", "b") for i in range(60)]
    odd_one = [(500, " ".join(f"z{k:02d}ab##" for k in range(60)), "en", "a"), (501, None, None, None), (502, "short", "en", "a")]
    found = by_id(quality_rules.judge(make(spark, clean + noisy + odd_one)))
    assert all(found[i]["kept"] for i in range(60)) and all(found[100 + i]["kept"] for i in range(60))
    assert not found[500]["kept"] and not found[500]["base_failed"]
    assert found[501]["base_failed"] and found[502]["base_failed"] and not found[502]["kept"]


def test_quality_odd_rows(spark, odd):
    assert quality_rules.judge(odd).count() == 8
    assert quality_rules.judge(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- sharding


def test_shards_hold_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(2000)]
    placed = sharding.interleave_shards(make(spark, rows)).collect()
    shards = collections.defaultdict(list)
    for r in placed:
        shards[r["shard"]].append(r)
    assert sorted(shards) == list(range(24)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    total = collections.Counter(r["source"] for r in placed)
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        for source, n in collections.Counter(r["source"] for r in members).items():
            assert abs(n - total[source] * len(members) / 2000) <= 2
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave_shards(make(spark, rows[::-1])).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in placed}


def test_shards_odd_rows(spark, odd):
    placed = sharding.interleave_shards(odd).collect()
    assert len(placed) == 8 and sorted(r["position"] for r in placed) == list(range(8))
    found = {r["doc_id"]: r for r in placed}
    assert found[1]["size"] == 8 and found[1]["text_crc32"] == 0
    assert found[5]["text_crc32"] == zlib.crc32(b"same text here") and found[5]["size"] == 22
    assert sharding.interleave_shards(odd.limit(0)).count() == 0


def test_shards_equal_a_plain_sort(spark):
    """Ranks, fractions and cuts by sorting in Python; only the seeded hashes come from Spark."""
    rows = [(i % 700 if i % 5 else None, f"text {i % 40}", "en", None if i % 11 == 0 else f"one{i}" if i % 3 == 0 else "hot") for i in range(1500)]
    docs = make(spark, rows)
    seen = collections.Counter()
    keyed = []
    for i, t, _, src in rows:
        seen[i, t, src] += 1
        keyed.append((i, t, src, seen[i, t, src]))
    frame = spark.createDataFrame([(i, src, len(t) + 8, zlib.crc32(t.encode()), c) for i, t, src, c in keyed], "doc_id long, source string, size long, text_crc32 long, copy long")
    key = F.xxhash64(F.lit(sharding.SEED), "doc_id", "source", "size", "text_crc32", "copy").alias("key")
    offset = ((F.pmod(F.xxhash64(F.lit(sharding.SEED), F.lit("offset"), "source"), F.lit(1 << 20)) + 0.5) / float(1 << 20)).alias("u")
    plain = frame.select("*", key, offset).collect()
    by_source = collections.defaultdict(list)
    for r in plain:
        by_source[r["source"]].append(r)
    ranked = []
    for source, members in by_source.items():
        for k, r in enumerate(sorted(members, key=lambda r: r["key"] % (1 << 64)), 1):
            ranked.append(((k - r["u"]) / len(members), source is None, source or "", r))
    ranked.sort(key=lambda x: (*x[:3], x[3]["key"]))
    want = collections.Counter((r["doc_id"], r["source"], r["text_crc32"], at * 24 // 1500, at) for at, (*_, r) in enumerate(ranked))
    found = sharding.interleave_shards(docs).collect()
    assert collections.Counter((r["doc_id"], r["source"], r["text_crc32"], r["shard"], r["position"]) for r in found) == want


def test_copies_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(text_columns, "COPIES_AT_ONCE", 7)
    rows = spark.createDataFrame([(None, "x")] * 50 + [(1, "y"), (1, "z"), (2, None)], "a long, b string")
    found = sorted((r["a"] or 0, r["b"] or "", r["copy"]) for r in text_columns.numbered_copies(rows, "test").collect())
    assert found == sorted([(0, "x", k) for k in range(1, 51)] + [(1, "y", 1), (1, "z", 1), (2, "", 1)])


# ---------------------------------------------------------------- mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        rest = sum(weight[s] for s in order if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else left * weight[s] / rest for s in order}
        above = {s for s in order if s not in stopped and target[s] > most * sizes[s]}
        if not above:
            return target
        stopped |= above


def test_mixing_targets(spark):
    for sizes in ({"a": 10, "b": 100, "c": 1000, None: 50}, {"a": 1, "b": 1, "c": 100, "d": 1, "e": 7, "f": 900}, {"a": 0, "b": 5}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        assert found == pytest.approx(plain_targets(sizes))


def test_mixing_repeats_documents(spark):
    rows = make(spark, [(i, " ".join(["w"] * (i % 9 + 1)), "en", f"s{i % 4}") for i in range(3000)])
    rates = mixing.document_rates(rows).collect()
    taken = collections.Counter()
    for r in rates:
        taken[r["doc_id"] % 4, r["target"]] += r["copies"] * r["size"]
        assert r["copies"] <= 3 and r["rate"] - 1 < r["copies"] < r["rate"] + 1
    assert all(abs(n - target) < 0.25 * target for (_, target), n in taken.items())
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix_documents(rows).collect())
    assert mixed == {r["doc_id"]: r["copies"] for r in rates if r["copies"]}
    assert mixing.mix_documents(rows).columns == rows.columns


def test_mixing_odd_rows(spark, odd):
    found = mixing.document_rates(odd).collect()
    assert len(found) == 8 and {r["size"] for r in found if r["doc_id"] in (1, 2, 3, 7)} == {0}
    assert mixing.document_rates(odd.limit(0)).count() == 0 and mixing.mix_documents(odd.limit(0)).count() == 0


def test_mixing_draws_rows_without_ids_apart(spark):
    rows = [(None, "w w", "en", "a")] * 1000 + [(7, f"w w{i}", "en", "b") for i in range(1000)] + [(i, "w w w w", "en", "c") for i in range(1000)]
    docs = make(spark, rows)
    taken = {r["source"]: r["n"] for r in mixing.mix_documents(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    want = plain_targets({"a": 2000, "b": 2000, "c": 4000})
    assert all(abs(taken[k] * (4 if k == "c" else 2) - want[k]) < 0.1 * want[k] for k in want)
    per_row = mixing.document_rates(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("doc_id is null").first()["n"]
    assert per_row == taken["a"]


def test_attach_salted_equals_broadcast(spark, odd):
    small = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, w int")
    rows = [sorted((str(r["doc_id"]), r["w"] or 0) for r in attach(odd, small, ["source"], "doc_id", most).collect()) for most in (0, 100)]
    assert rows[0] == rows[1] and len(rows[0]) == 8
