"""Near-duplicate texts and vectors against brute force, and the pipeline's stages."""

import collections
import random

import numpy as np
import pytest

from newsloom.llm import embedding_dedup, minhash_dedup
from newsloom.llm.word_hashes import mix, shingle_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id long, bucket long, component long, kept boolean, a long, rep long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, -1, -1, -1, None, -1, -1) for i, t in rows], SCHEMA)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def bag(text):
    words = (text or "").encode().split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def plain_classes(rows):
    bags = [(i, bag(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(bags) for b, y in bags[:k] if x and y and 10 * sum((x & y).values()) >= 8 * sum((x | y).values())]
    return components([i for i, _ in rows], links)


def test_word_hashes_follow_words():
    a, b = word_hashes("one  two\tone\n".encode()), word_hashes(b"one two one")
    assert (a == b).all() and a[0] == a[2] != a[1]
    assert len(word_hashes(b"")) == 0 and len(shingle_hashes(b" \n")) == 0 and len(shingle_hashes(b"a b")) == 1
    assert len(word_hashes("a b c".encode())) == 2


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    for most in (2, 4, 30):
        truth, guess = [], []
        for _ in range(60):
            start = int(rng.integers(1 << 40))
            a = {start + i: int(rng.integers(1, most)) for i in range(50)}
            b = {k: (int(rng.integers(1, most)) if rng.random() < 0.4 else v) for k, v in a.items() if rng.random() < 0.9}
            x, y = collections.Counter(a), collections.Counter(b)
            truth.append(sum((x & y).values()) / sum((x | y).values()))
            sigs = [minhash_dedup.bag_signature(mix(np.array(sorted(c), np.uint64)), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
            guess.append((sigs[0] == sigs[1]).mean())
        assert abs(np.mean(truth) - np.mean(guess)) < 0.02
        assert np.std(np.array(truth) - guess) < 0.05


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for group in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        for copy in range(rng.choice([1, 2, 3, 8])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    hub = [rng.choice(words) for _ in range(150)]
    for copy in range(60):
        text = list(hub)
        if copy:
            for at in rng.sample(range(150), 2):
                text[at] = f"x{copy}"
        rows.append((n, " ".join(text)))
        n += 1
    chain = [rng.choice(words) for _ in range(200)]
    for k in range(12):
        chain[k * 15] = f"c{k}"
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "\n \t"), (n + 3, "tiny"), (n + 4, "tiny"), (n + 5, "a b c d"), (n + 6, "r " * 4000), (n + 7, "r " * 4001)]
    return rows


def test_near_duplicates_equal_brute_force(spark, corpus):
    want = plain_classes(corpus)
    found = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(make(spark, corpus)).collect()}
    assert {i: r["class_id"] for i, r in found.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in found.items())


def test_near_duplicates_in_small_blocks(spark, corpus, monkeypatch):
    for name, value in {"BLOCK": 7, "FEW_PAIRS": 0, "COLUMNS": 16, "TASK_ROWS": 5, "MAX_BROADCAST_IDS": 0}.items():
        monkeypatch.setattr(minhash_dedup, name, value)
    found = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(make(spark, corpus)).collect()}
    assert found == plain_classes(corpus)


def test_overlaps_both_ways():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 5000, rng.integers(0, 900))) for _ in range(30)] for _ in range(2))
    pairs = rng.random((30, 30)) < 0.5
    want = np.array([[len(set(x) & set(y)) for y in right] for x in left])
    for few in (0, 10_000):
        minhash_dedup.FEW_PAIRS, kept = few, minhash_dedup.FEW_PAIRS
        found = minhash_dedup.overlaps(left, right, pairs)
        minhash_dedup.FEW_PAIRS = kept
        assert (found[pairs] == want[pairs]).all()


def test_near_duplicates_of_very_long_texts(spark):
    """One bucket of 70 texts of some 60,000 shingles whose overlaps lie just above and just below 0.8."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 50_000, 60_000).astype(str)
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        text = base.copy()
        changed = 1390 if i % 2 else 1260
        text[rng.choice(11_999, changed, replace=False) * 5] = f"x{i}"
        rows.append((i, " ".join(text)))
    bags = [bag(t) for _, t in rows]
    near = {i for i in range(1, 70) if 10 * sum((bags[0] & bags[i]).values()) >= 8 * sum((bags[0] | bags[i]).values())}
    assert near == set(range(2, 70, 2))
    found = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(make(spark, rows)).collect()}
    assert found == {i: 0 if i in near else i for i, _ in rows}


def test_near_duplicates_odd_rows(spark):
    rows = make(spark, [(1, "one two three"), (1, "one two three"), (1, "one  two three"), (None, "one two three"), (2, None), (2, None), (3, "one two three")])
    found = minhash_dedup.near_duplicates(rows).collect()
    assert len(found) == 7 and sorted((r["doc_id"], r["kept"]) for r in found if r["doc_id"]) == [(1, False), (1, False), (1, True), (2, True), (2, True), (3, False)]
    assert [r["kept"] for r in found if r["doc_id"] is None] == [True]
    left = minhash_dedup.drop_near_duplicates(rows)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 2] and left.columns == rows.columns
    assert minhash_dedup.near_duplicates(rows.limit(0)).count() == 0 and minhash_dedup.drop_near_duplicates(rows.limit(0)).count() == 0


def test_similar_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "TASK_ROWS", 40)
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(24)
            for _ in range(int(rng.integers(1, 12))):
                v = centre + rng.standard_normal(24) * rng.choice([0.0, 0.02, 0.08, 0.12])
                rows.append((n, (v * rng.choice([1, 3])).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 24, 0), (n + 3, [float("nan")] * 24, 0), (n + 4, [None] * 24, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [float("inf")] + [0.0] * 23, 1)]
    ok = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.98]
    count = collections.Counter(x for pair in links for x in pair)
    want = components([i for i, _, _ in rows], links)
    frame = spark.createDataFrame([(*r, -1, -1) for r in rows], "vec_id long, embedding array<float>, label int, rep long, n long")
    found = {r["vec_id"]: r for r in embedding_dedup.similar_vectors(frame).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == {i: count[i] for i, _, _ in rows}
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert len(links) > 50 and embedding_dedup.similar_vectors(frame.limit(0)).count() == 0


def test_similar_vectors_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label string"
    found = embedding_dedup.similar_vectors(spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [2.0], "a,1.0"), (3, [1.0, 2.0], "a,2.0")], schema)).collect()
    assert all(r["n_links"] == 0 and r["kept"] for r in found) and len(found) == 3
    rows = [(5, [1.0, 1.0], "a"), (5, [1.0, 1.0], "a"), (6, [2.0, 2.0], "a"), (None, [1.0, 1.0], "a"), (None, None, None), (7, [1.0, 1.0], None)]
    found = embedding_dedup.similar_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, 0, True), (0, 0, 0, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 0, 7, True)]


def test_table_shape_keeps_recall():
    for classes in (0, 10, 10_000, 10**6, 10**9):
        tables, hashes = embedding_dedup.table_shape(classes)
        assert (1 - embedding_dedup.NEAR_SHARED**hashes) ** tables <= embedding_dedup.MISSED
        assert classes * embedding_dedup.FAR_SHARED**hashes <= embedding_dedup.FILL
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    keys = [embedding_dedup.table_keys(x, 40, 1) for x in (a, b, side / np.linalg.norm(side, axis=1, keepdims=True))]
    assert (keys[0] == keys[1]).mean() >= embedding_dedup.NEAR_SHARED - 0.005 and (keys[0] == keys[2]).mean() < embedding_dedup.FAR_SHARED + 0.01


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "MinHash near-dedup", "mixing", "SentencePiece"]
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, before, sf_dir)
        assert after.columns == docs.columns
        before = after.cache()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == before.count() and {"doc_id", "ids_sha256"} <= set(out.columns)
    near = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir)
    want = plain_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in near.select("doc_id").collect()} == {i for i, c in want.items() if i == c}


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"{rng.choice('bdgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdgklmnprst')}{i}x" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(60)]
    rows = [(i, t, "en", "s", 9, "x", 1) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "s", 9, "x", 1)] * 3 + [(None, texts[1], None, None, None, None, None), (100, None, "en", "s", 0, "x", 1), (101, "", "en", "s", 0, "x", 1), (102, texts[2], "en", None, 9, "y", 2)]
    rows.append((103, "long words again " * 20_000, "en", "s", 9, "x", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, copies long")
    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and 0 < after.count() <= 3 * docs.count()
        assert function(spark, docs.limit(0), str(tmp_path)).count() == 0
    near = {(r["doc_id"], r["n"]) for r in corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert (0, 1) in near and (None, 1) in near and not any(i == 102 for i, _ in near) and {(100, 1), (101, 1), (103, 1)} <= near
    known = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in known.collect()} == {*range(60), None, 102, 103}
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() == len(rows) and last(spark, docs.limit(0), str(tmp_path)).count() == 0


CLASHING = ["copy", "copy__", "__n", "__rate", "__id", "_id", "id", "row", "digest", "times", "__copies", "__copy", "__part", "__c0", "c0", "_c0", "C1", "__salt", "__source", "k", "rate"]


def test_callers_columns_keep_their_values(spark):
    """Names that operators use, maps, repeated and null ids: each row's own values stay with it."""
    from newsloom.llm import line_dedup, mixing

    rng = random.Random(7)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(90)]) for _ in range(30)) for _ in range(12)]
    rows = [(i if i % 4 else i // 2, texts[i % 12], "ab"[i % 2], {"k": i, "a": 1}, *[i * 100 + k for k in range(len(CLASHING))]) for i in range(24)]
    rows += [rows[4], (None, *rows[5][1:]), (None, *rows[5][1:]), (70, None, None, None, *[5] * len(CLASHING))]
    schema = "doc_id long, text string, source string, map map<string,long>, " + ", ".join(f"`{c}` long" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    plain = lambda rs: collections.Counter(str((r["doc_id"], r["text"], r["source"], sorted((r["map"] or {}).items()), *r[4:])) for r in rs)
    own = plain(docs.collect())

    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    found = plain(mixed.collect())
    assert set(found) <= set(own) and all(n <= 3 * own[r] for r, n in found.items()) and sum(found.values()) > 20
    assert found == plain(mixing.mix_documents(docs.repartition(3)).collect())

    once = minhash_dedup.drop_near_duplicates(docs)
    assert once.columns == docs.columns
    kept = plain(once.collect())
    assert set(kept) <= set(own)
    left = [r["text"] for r in once.where("doc_id is not null and text is not null").collect()]
    assert len(left) == len(set(left)) >= 8 and set(left) <= set(texts)  # ids that texts share make them one document
    assert minhash_dedup.near_duplicates(docs).count() == len(rows)

    lines = line_dedup.drop_repeated_lines(docs)
    assert plain(lines.select(docs.columns).collect()) == plain(docs.na.fill("", ["text"]).collect())
