"""Toxicity, language identification, encoding and language-model scoring."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from newsloom.llm import language_id, lm_scoring, sentencepiece_codec, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, toxic int, chunk int, data string, gram long"


def make(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, lang, "s", 0, -1.0, None, -1, "x", -1) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = "long wörds again " * 8000
    return make(spark, [(1, None, "en"), (2, "", None), (3, " 12 \n# ", "en"), (4, long, "en"), (5, "same text", "en"), (5, "same text", "en"), (None, "no id", "en")])


# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def abuse(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abdeghmnoprtu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        if i % 5 == 0:
            for _ in range(2):
                text[rng.randrange(len(text))] = rng.choice(["Vilkoz", "vilkozen", "SKARNIF", "skarnif"])
        docs.append((i, " ".join(text), "en"))
        labels.append((i, int(i % 5 == 0)))
    return make(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_folds(spark, abuse):
    model = toxicity.fit(*abuse)
    assert {e[:4] for e in model.entries} == {toxicity.fold(w).strip()[:4] for w in ("vilk", "skar")}
    assert all(model.score(t) >= 0.5 for t in ("you vilkoz", "a V1LK0Z!", "ѕkarnіf there", "sk​arnif", "$k4rn1f now"))
    assert all(model.score(t) < 0.5 for t in (None, "", "gentle words", "vil koz", "evilkoz", "123"))
    assert model.score("vilkoz " * 3) > model.score("vilkoz " + "word " * 500)


def test_toxicity_exceptions():
    model = toxicity.ToxicModel({toxicity.fold("clown").strip(): 5.0}, (-3.0, 3.0, 0.0), ["clown fish"])
    assert model.score("a clown") > 0.5 > model.score("a clown fish swims") and model.score("clown fish and clown") > 0.5


def test_toxicity_measures_equal_a_plain_scan():
    """Each folded word is held against every entry; words of an exception phrase are left out."""
    rng = random.Random(2)
    entries = {"bad": 2.0, "bade": 3.5, "ugl": 1.5, "verylongwordindeed ": 4.0, "mon ": 2.5}
    phrases = ["bad luck", "ugly duck ling"]
    model = toxicity.ToxicModel(entries, (0.0, 1.0, 1.0), phrases)
    pool = ["bad", "badly", "bader", "luck", "ugly", "duck", "ling", "verylongwordindeed", "verylongwordindeeds", "mon", "monday", "BÄD", "b4d", "x"]
    for _ in range(400):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(1, 25)))
        words = toxicity.fold(text).split()
        weight = [max((w for e, w in entries.items() if (f"{x} " == e if e.endswith(" ") else x.startswith(e))), default=0.0) for x in words]
        for phrase in phrases:
            p = toxicity.fold(phrase).split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    weight[i : i + len(p)] = [0.0] * len(p)
        total = sum(weight)
        assert model.measures(text) == pytest.approx((total, total / math.sqrt(len(words))))


def test_toxicity_lexicon_needs_both_halves():
    sizes = {(h, label): 200 for h in (0, 1) for label in (0, 1)}
    row = lambda term, a, b, c, d: {"term": term, "c01": a, "c00": b, "c11": c, "c10": d}
    kept = toxicity._lexicon([row("one", 30, 0, 0, 0), row("both", 30, 0, 25, 0), row("clean", 30, 30, 30, 30), row("bo", 40, 20, 30, 20)], sizes)
    assert set(kept) == {"both"} and kept["both"] > 3


def test_toxicity_learns_phrases_and_long_words(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        text = ["".join(rng.choice("aeoprstn") for _ in range(6)) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic:
            text[rng.randrange(12)] = "vlikoz" if i % 2 else "grumbelkwastenfratz"
        elif i % 40 == 4:
            text[5:7] = ["vlikoz", "garden"]
        elif i % 4 == 1:
            text[5] = "grumbelkwastenfratzwerk"
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None)]
    model = toxicity.fit(make(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.score("you vlikoz") > 0.5 > model.score("the vlikoz garden here") and model.score("grumbelkwastenfratz") > 0.5 > model.score("grumbelkwastenfratzwerk")


def test_toxicity_held_out_rows(spark, abuse):
    found = toxicity.rate_toxicity(*abuse).join(abuse[1], "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert 80 < len(held) < 160 and all(r["predicted"] == r["toxic"] for r in held)


def test_toxicity_odd_rows(spark, odd, abuse):
    model = toxicity.fit(*abuse)
    assert toxicity.score(odd, model).count() == 7 and toxicity.score(odd.limit(0), model).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.rate_toxicity(odd, none).collect()} == {0}
    assert toxicity.keep_clean(odd, model).columns == odd.columns


# ---------------------------------------------------------------- language


def small_corpus(n):
    rng = random.Random(6)
    words = {"aa": "the and of mill stone river over", "bb": "der und von muehle stein fluss ueber", "cc": "le et de moulin pierre riviere sur"}
    return [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randint(3, 12))), k) for i, k in ((i, rng.choice(list(words))) for i in range(n))]


def test_language_equals_plain_kernel_ridge(spark):
    """With every distinct text as landmark and sample, the Nystroem model is kernel ridge regression over sets of n-grams."""
    rows = small_corpus(90)
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=500, landmarks=500)
    texts = sorted({(t, k) for _, t, k in rows})
    pieces = [(p, k) for t, k in texts for p in language_id._pieces(t)]
    grams = lambda t: set(language_id.present(t).tolist())
    plain = lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5
    marks, taught = [grams(t) for t, _ in texts], [grams(p) for p, _ in pieces]
    k_mm = np.array([[plain(x, y) for y in marks] for x in marks])
    k_pm = np.array([[plain(x, y) for y in marks] for x in taught])
    signs = np.array([[1.0 if k == own else -1.0 for k in ("aa", "bb", "cc")] for _, own in pieces])
    alpha = np.linalg.lstsq(k_pm.T @ k_pm + language_id.RIDGE * len(pieces) * k_mm, k_pm.T @ signs, rcond=1e-10)[0]
    asked = ["the stone und river", "moulin sur", "fluss ueber stein", "of the of", "zzz"]
    want = np.array([[plain(grams(t), z) for z in marks] for t in asked]) @ alpha
    names, scores = model.predict(asked)
    assert names == [("aa", "bb", "cc")[i] for i in want.argmax(1)]
    assert scores == pytest.approx(np.clip((want.max(1) + 1) / 2, 0, 1), abs=2e-3)


def test_language_products_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.random((50, 3))
    rows = [rng.choice(50, n, replace=False) for n in (5, 0, 1, 40, 7, 0)]
    want = [table[r].sum(0) / np.sqrt(len(r)) if len(r) else np.zeros(3) for r in rows]
    for cells in (1, 10, 1000):
        monkeypatch.setattr(language_id, "CELLS", cells)
        assert np.allclose(language_id._product(rows, table), want, atol=1e-5)


def test_language_rejects_unlearnt_scripts_and_keeps_mixtures(spark):
    schema = "doc_id long, text string, lang string"
    model = language_id.fit(spark.createDataFrame(small_corpus(300), schema))
    asked = [(1, "совсем другой язык и другие буквы", None), (2, "你好世界", None), (3, "the river und der stein", None), (4, "moulin sur", None), (5, "12 34", None)]
    assert sorted(r["doc_id"] for r in language_id.keep_identified(spark.createDataFrame(asked, schema), model).collect()) == [3, 4]


def test_language_number_and_null_ids(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(i, f"abc{'x' * i}", f"l{i}") for i in range(6)], schema)
    more = docs.union(docs.where("doc_id >= 3"))
    assert language_id.fit(more, max_languages=4).languages == ["l0", "l3", "l4", "l5"]
    assert language_id.fit(docs, max_languages=6).languages == [f"l{i}" for i in range(6)]
    same = spark.createDataFrame([(None, t, k) for _, t, k in small_corpus(60)] + [(None, "the and of", "aa")] * 200, schema)
    assert language_id.fit(same, fit_rows=20, landmarks=5).predict(["der und von", "le et de"])[0] == ["bb", "cc"]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.count() > 250 and found.where("lang <> lang_pred").count() <= 3


def test_language_kernel_is_presence():
    a, b = language_id.present("abc abc"), language_id.present("ABC, abc!")
    assert (a == b).all()
    k = language_id.kernel([a], [a, language_id.present("xyz")])
    assert k[0, 0] == pytest.approx(1, abs=1e-6) and k[0, 1] < 0.3


def test_language_odd_rows(spark, odd):
    found = language_id.identify(odd).collect()
    assert len(found) == 7
    assert [(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in found)
    assert language_id.identify(odd.limit(0)).count() == 0
    model = language_id.fit(odd)
    assert language_id.keep_identified(odd, model).columns == odd.columns


# ---------------------------------------------------------------- encoding


def test_encoding_equals_the_library():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_vocabulary(MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    alphabet = "ab the ing  ▁▁éß²..,,\n\t\x00😀日本語한국 <s></s><0x41>0123 ÀÉ́​\r\n##//=>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [" " * k + "x" + " " * k for k in range(40)] + ["", " ", "▁" * 37, "a" * 5000, "#" * 3000, "Ünïcödé wörds " * 300]
    for text in texts:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = codec.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert codec.decode(got) == library.decode(want), text


def test_encoding_rows(spark, odd):
    rows = sentencepiece_codec.encode_documents(odd, MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == 7
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        data = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], bytes(r["ids"])) == (len(ids), hashlib.sha256(data).hexdigest(), data)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(odd.limit(0), MODEL).count() == 0


# ---------------------------------------------------------------- language models


def plain_scores(docs, target, order, common, strength=lm_scoring.STRENGTH):
    """Word models from dictionaries; the background of a document is counted anew over all others."""
    aimed = {w for t in target for w in t.lower().split()}
    everywhere = collections.Counter(w for t in docs for w in (t or "").lower().split())
    known = aimed | {w for w, n in everywhere.items() if n * common >= everywhere.total()}

    def numbered(text):
        return ["<"] * (order - 1) + [w if w in known else "?" for w in (text or "").lower().split()]

    def counted(texts):
        counts, contexts = collections.Counter(), collections.Counter()
        for w in map(numbered, texts):
            for i in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    counts[tuple(w[i - k + 1 : i + 1])] += 1
                    contexts[tuple(w[i - k + 1 : i]), k] += 1
        return counts, contexts

    pooled = collections.Counter(w for t in [*docs, *target] for w in numbered(t)[order - 1 :])

    def p(model, gram):
        q = pooled[gram[-1]] / pooled.total()
        for k in range(1, order + 1):
            x, weight = tuple(gram[order - k :]), strength if k > 1 else len(aimed)
            q = (model[0][x] + weight * q) / (model[1][x[:-1], k] + weight)
        return q

    aim, out = counted(target), []
    for at, text in enumerate(docs):
        back, w = counted(docs[:at] + docs[at + 1 :]), numbered(text)
        losses = [math.log(p(back, w[i - order + 1 : i + 1])) - math.log(p(aim, w[i - order + 1 : i + 1])) for i in range(order - 1, len(w))]
        out.append((sum(losses) / len(losses), len(losses)) if losses else (None, 0))
    return out


@pytest.mark.parametrize(("order", "common"), [(1, 50), (2, 50), (3, 50), (2, 3), (2, lm_scoring.COMMON)])
def test_lm_scores(spark, order, common):
    texts = ["the cat sat on the mat", "A cat", "z", None, "", " \t", "über die brücke", "the cat sat on the mat", "zzzz the \0 qqqq " * 50]
    target = ["The cat sat", "on the mat the dog sat", "\0 über"]
    aims = spark.createDataFrame([(t,) for t in [*target, None, ""]], "text string")
    found = {r["doc_id"]: r for r in lm_scoring.score_documents(make(spark, [(i, t, "en") for i, t in enumerate(texts)]), aims, order=order, common=common).collect()}
    assert len(found) == len(texts)
    for i, (want, n) in enumerate(plain_scores(texts, target, order, common)):
        assert found[i]["score"] == (pytest.approx(want, abs=1e-9) if want is not None else None)
        assert found[i]["n_tokens"] == n
    assert found[0]["score"] == found[7]["score"]


def test_lm_runs_of_the_target_come_first(spark):
    """Texts that hold 20 words of the target in a row come before others, whose words may be the target's too."""
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(3000)]
    aims = [" ".join(rng.choice(pool[:600]) for _ in range(30)) for _ in range(40)]
    shares = [rng.random() for _ in range(400)]
    texts = [" ".join(rng.choice(pool[:600]) if rng.random() < share else rng.choice(pool[600:]) for _ in range(60)) for share in shares]
    for k in range(0, 400, 10):
        texts[k] += " " + " ".join(aims[k // 10].split()[5:25])
    docs = make(spark, [(k, t, "en") for k, t in enumerate(texts)])
    found = lm_scoring.score_documents(docs, spark.createDataFrame([(t,) for t in aims], "text string"))
    scores = [r["score"] for r in sorted(found.collect(), key=lambda r: r["doc_id"])]
    assert max(scores[k] for k in range(0, 400, 10)) < min(scores[k] for k in range(400) if k % 10 and shares[k] < 0.5)


def test_lm_odd_rows(spark, odd):
    none = spark.createDataFrame([], "text string")
    rows = lm_scoring.score_documents(odd, none).collect()
    assert len(rows) == 7 and sum(r["score"] is None for r in rows) == 2
    assert lm_scoring.score_documents(odd.limit(0), none).count() == 0


def test_lm_copies_are_dealt_one_by_one(spark):
    rows = [(None, "the cat sat")] * 3000 + [(7, "the cat sat")] * 40 + [(i, f"on the mat {i}") for i in range(100, 160)] + [(None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = lm_scoring.deal(docs.select("doc_id", F.col("text").cast("binary").alias("data")), 12)
    counts = {r["chunk"]: r["count"] for r in dealt.where("doc_id is null").groupBy("chunk").count().collect()}
    assert sum(counts.values()) == 3001 and len(counts) == 12 and max(counts.values()) < 600
    first, second = (sorted((r["doc_id"] or 0, r["chunk"]) for r in dealt.collect()) for _ in range(2))
    assert first == second and len(first) == len(rows)
    found = lm_scoring.score_documents(docs, spark.createDataFrame([("the cat sat",)], "text string")).collect()
    assert len(found) == len(rows) and len({r["score"] for r in found if r["n_tokens"] == 3}) == 1


def test_lm_pieces_do_not_matter():
    texts = [b"a b c a", b"", b"x", b"hello a b world"]
    words = np.sort(np.unique(np.concatenate([lm_scoring.word_hashes(t) for t in texts[:1]])))
    for order in (1, 2, 3):
        whole, sizes = lm_scoring.word_grams(texts, words, order)
        parts = [lm_scoring.word_grams(p, words, order) for p in lm_scoring._pieces(texts, 7)]
        assert (whole == np.concatenate([g for g, _ in parts])).all() and len(whole) == sizes.sum() == 9


def test_lm_vocabulary_is_bounded(spark):
    target = spark.createDataFrame([("a " * 50 + "b " * 10 + " ".join(f"w{i}" for i in range(40)),)], "text string")
    assert len(lm_scoring.vocabulary(target)) == 42 and len(lm_scoring.vocabulary(target, 10)) == 2


def test_language_with_a_wrong_tag_on_many_rows(spark):
    schema = "doc_id long, text string, lang string"
    wrong = [(1000 + k, f"nothing like these {k}", f"tag{k}") for k in range(500)]
    docs = spark.createDataFrame(small_corpus(300) + wrong, schema)
    model = language_id.fit(docs, max_languages=3)
    assert len(model.languages) == 3 and model.predict(["der und von", "le et de"])[0] == ["bb", "cc"]
    assert language_id.predict(docs, model).count() == docs.count()


def test_toxicity_sample_of_an_id_with_many_texts(spark):
    """An id shared by 5,000 texts brings one row to the sample, whichever the order of rows."""
    rows = [(1, f"shared id text number {k}") for k in range(5000)]
    rows += [(k, f"{'foulword vileword' if k % 2 else 'plain kind'} text about {k}") for k in range(2, 202)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 202)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [toxicity.fit(d, labels) for d in (docs, docs.orderBy("text").repartition(3))]
    assert models[0].entries == models[1].entries and models[0].logistic == pytest.approx(models[1].logistic)
    assert models[0].score("a foulword vileword here") > 0.5 > models[0].score("plain kind text")
