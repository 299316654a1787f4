"""Toxicity by a weighted lexicon.

Texts are folded: compatibility forms, accents, case, look-alike letters of other scripts, digits and signs that stand
for letters, and invisible characters. Lexicon entries are folded beginnings of words; one Aho-Corasick pass over the
folded text finds them, the longest at each word counts, and words inside an exception phrase do not. A text's score is
a logistic function of its summed weight and of that sum per square root of its length in words.

The lexicon is learnt from a bounded sample of labelled rows (`fit_rows` toxic and twice as many others, those of the
smallest hashes, one of each group of copies), cut in two halves by text. Tasks count in how many texts of either label
and half each beginning of a word, and each long word as a whole, occurs. A term is selected on one half, by support and
log-odds ratio, and weighed on the other, which must find the same; its weight is its log-odds ratio there. Exception
phrases are given ones and learnt ones: two words around a match that occur in texts called clean, not in toxic ones.
The logistic weights are fitted on the sample. All rows are scored whole.

Defined cases: null, empty and wordless texts get the score of a text without matches; very long texts and words count
whole; rows without a label, or with a null one, teach nothing; several labels of one id teach as toxic if one is 1;
null ids teach nothing, and texts that share an id teach each; a text in which nothing matches scores below 0.5 whatever
the labels say (`MAX_BIAS`), so labels of one kind alone, from which no term can be learnt, call nothing toxic; equal texts get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.language_id import in_fold
from newsloom.llm.memory import releasing
from newsloom.plans.staging import stage

FIT_ROWS = 3000
#: Letters of a beginning of a word; longer words are entries as a whole.
SHORTEST, LONGEST = 3, 12
#: A term needs this many toxic texts of a half, and this share of those there.
LEAST_TEXTS, LEAST_SHARE = 3, 0.005
#: Least log-odds ratio on the half that selects and on the one that weighs.
LEAST_WEIGHT, LEAST_OTHER = 3.0, 2.5
#: Log-odds of a text without matches at most.
MAX_BIAS = -0.5
#: Clean texts that hold a learnt exception phrase at least.
LEAST_CLEAN = 3
#: Characters folded to the ASCII letter they pass for (lower case; l and 1 count as i).
LOOK_ALIKES = {
    "a": "аαɑ@4", "b": "вβ8", "c": "сϲƈ", "d": "ԁɗ", "e": "еєεёɛ3", "f": "ƒ", "g": "ɡ", "h": "һн", "i": "іιıȋl1|ӏⅼ",
    "j": "јϳ", "k": "кκ", "m": "мⅿ", "n": "ոη", "o": "оοօσ0", "p": "рρ", "q": "ԛ", "r": "гɾ", "s": "ѕʂ5$", "t": "тτ7",
    "u": "υսц", "v": "ѵν", "w": "ԝωш", "x": "хχ", "y": "уγү", "z": "ʐ",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases whose words are harmless together.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum", "idiot proof")

_FOLD = {ord(c): letter for letter, others in LOOK_ALIKES.items() for c in others} | {ord(c): None for c in INVISIBLE}
_NOT_WORD = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """The text in folded words, each after one space, with a space at the end."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return f" {_NOT_WORD.sub(' ', text.lower().translate(_FOLD))} ".replace("  ", " ")


def _terms(text: str) -> set[str]:
    """Beginnings of the text's folded words, and words of more than LONGEST letters with a space at the end."""
    words = set(fold(text).split())
    return {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {f"{w} " for w in words if len(w) > LONGEST}


class ToxicModel:
    """entries: folded beginning of a word (a whole word, if it ends in a space) -> weight. exceptions: phrases, folded
    before use. logistic: bias, weight of the sum, weight of the rate."""

    def __init__(self, entries: dict[str, float], logistic: tuple[float, float, float], exceptions: Sequence[str] = EXCEPTIONS):
        self.entries, self.logistic, self.exceptions = entries, logistic, tuple(exceptions)
        self._automaton = None

    def __getstate__(self):
        return self.entries, self.logistic, self.exceptions

    def __setstate__(self, state):
        self.entries, self.logistic, self.exceptions = state
        self._automaton = None

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                self._automaton.add_word(f" {entry}", (len(entry) + 1, weight))
            for phrase in self.exceptions:
                self._automaton.add_word(fold(phrase), (len(fold(phrase)), None))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> dict[int, float]:
        """Weight by place of the space before each matched word that no exception phrase holds."""
        matched: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton().iter(folded):
            start = end - length + 1
            if weight is None:
                excepted.append((start, end))
            else:
                matched[start] = max(weight, matched.get(start, 0.0))
        for start, end in excepted:
            for at in [a for a in range(start, end) if a in matched]:
                del matched[at]
        return matched

    def measures(self, text: str | None) -> tuple[float, float]:
        """Summed weight of matched words, and that sum over the square root of the number of words."""
        if not text or not (self.entries or self.exceptions):
            return 0.0, 0.0
        folded = fold(text)
        matched = self.matches(folded)
        total = sum(matched.values())
        return total, total / math.sqrt(max(1, folded.count(" ") - 1))

    def phrases(self, text: str) -> set[str]:
        """Each matched word with the word before it, and with the one after it."""
        folded, out = fold(text), set()
        for at in self.matches(folded):
            end = folded.find(" ", at + 1)
            before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
            if before >= 0:
                out.add(folded[before + 1 : end])
            if after > 0:
                out.add(folded[at + 1 : after])
        return out

    def score(self, text: str | None) -> float:
        total, rate = self.measures(text)
        bias, a, b = self.logistic
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + a * math.log1p(total) + b * math.log1p(rate)))))


def _copy_keys(text: str) -> tuple[int, int, int]:
    """Numbers that near copies mostly share: the smallest hash of five words in a row, for three hashes."""
    words = text.encode().split()
    runs = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return tuple(min(zlib.crc32(r, salt) for r in runs) for salt in (0, 7, 13))


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """text, toxic, half: of the sample (rank, text, toxic) one row, that of the smallest rank, for each value of any copy key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_copy_keys(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([k[i] for k in found], pa.int64()) for i in range(3)]], names=[*batch.schema.names, "k0", "k1", "k2"])

    rows = sample.mapInArrow(releasing(keys), "rank long, text string, toxic int, k0 long, k1 long, k2 long")
    for key in ("k0", "k1", "k2"):
        rest = [c for c in rows.columns if c != key]
        rows = rows.groupBy(key).agg(F.min(F.struct("rank", *[c for c in rest if c != "rank"])).alias("first")).select(key, *[F.col("first")[c].alias(c) for c in rest])
    return rows.select("text", "toxic", F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).cast("int").alias("half"))


def _lexicon(counts: list, sizes: dict[tuple[int, int], int]) -> dict[str, float]:
    """Weights of the kept terms; of nested ones with the same texts the longest. counts: term and c{half}{label}."""

    def weight(r, half: int) -> float:
        toxic, clean, p, n = sizes[half, 1], sizes[half, 0], r[f"c{half}1"], r[f"c{half}0"]
        return math.log((p + 0.5) / (toxic - p + 0.5)) - math.log((n + 0.5) / (clean - n + 0.5))

    good: dict[str, tuple[float, int]] = {}
    for r in counts:
        found = []
        for half in (0, 1):
            need = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * sizes[half, 1]))
            other = weight(r, 1 - half)
            if r[f"c{half}1"] >= need and weight(r, half) >= LEAST_WEIGHT and other >= LEAST_OTHER:
                found.append(other)
        if found:
            good[r["term"]] = sum(found) / len(found), r["c01"] + r["c11"]
    longer = {t[:k] for t in good for k in range(SHORTEST, len(t)) if t[:k] in good and good[t][1] >= 0.95 * good[t[:k]][1]}
    kept = {t: v for t, v in good.items() if t not in longer}
    chosen: dict[str, float] = {}
    for t in sorted(kept, key=lambda t: (len(t), t)):
        if not any(t[:k] in chosen for k in range(SHORTEST, len(t))):
            chosen[t] = kept[t][0]
    return chosen


def _logistic(rows: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge-penalised logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows)])
    w = np.zeros(3)
    penalty = np.diag([1e-3, 0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return min(MAX_BIAS, float(w[0])), float(w[1]), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions: Sequence[str] = EXCEPTIONS) -> ToxicModel:
    """Learn from docs (doc_id, text) with labels (doc_id, toxic); the caller keeps held-out rows away from labels.

    The sample's ids, 3 * fit_rows of them at most, are broadcast to the scan of docs; each brings one text, that of the
    smallest hash if several rows share the id, so the sample has no more rows than ids. The driver gets terms that a
    half's share of toxic texts holds: at most 1 / LEAST_SHARE times the terms of an average text, whatever the input.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = stage(marks.where("toxic in (0, 1)").withColumn("rank", F.xxhash64(F.lit("toxicity"), "doc_id")), "toxicity-labels")
    found = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = found.get(1, 0), found.get(0, 0)
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        return ToxicModel({}, (min(MAX_BIAS, math.log((share + 1e-6) / (1 - share + 1e-6))), 0.0, 0.0), exceptions)
    drawn = [marks.where(F.col("toxic") == label).orderBy("rank").limit(most) for label, most in ((1, fit_rows), (0, 2 * fit_rows))]
    ids = stage(drawn[0].unionByName(drawn[1]), "toxicity-ids")
    drawn_rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")  # an id may be on any number of texts: one of them is taken
    sample = drawn_rows.groupBy("rank", "toxic").agg(one).select("rank", F.col("one.text").alias("text"), "toxic")
    sample = stage(_one_of_copies(sample), "toxicity-sample").repartition(36, F.xxhash64("text"))
    sizes = {(half, label): 0 for half in (0, 1) for label in (0, 1)}
    sizes |= {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    columns = [f"c{half}{label}" for half, label in sizes]

    def count(batches: Iterator[pa.RecordBatch], terms) -> Iterator[pa.RecordBatch]:
        seen = {c: Counter() for c in columns}
        for batch in batches:
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns)):
                seen[f"c{half}{label}"].update(terms(text))
        names = sorted(set().union(*seen.values()))
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[t] for t in part], pa.int64()) for c in seen.values()]], names=["term", *columns])

    def counts(terms) -> DataFrame:
        each = sample.mapInArrow(releasing(lambda batches: count(batches, terms)), ", ".join(["term string", *[f"{c} long" for c in columns]]))
        return each.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns])

    need = [max(LEAST_TEXTS, math.ceil(LEAST_SHARE * sizes[half, 1])) for half in (0, 1)]
    often = counts(_terms).where((F.col("c01") >= need[0]) | (F.col("c11") >= need[1]))
    rates = lambda half: F.col(f"c{half}1") * sizes[half, 0] > 5 * F.col(f"c{half}0") * sizes[half, 1]
    model = ToxicModel(_lexicon(often.where(rates(0) & rates(1)).collect(), sizes), (MAX_BIAS, 0.0, 0.0), exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    harmless = counts(lambda text: shared.value.phrases(text)).where((F.col("c01") + F.col("c11") == 0) & (F.col("c00") + F.col("c10") >= LEAST_CLEAN))
    model = ToxicModel(model.entries, model.logistic, [*exceptions, *sorted(r["term"] for r in harmless.collect())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.measures(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), batch.column(1)], names=["total", "rate", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(releasing(measure), "total double, rate double, toxic int").collect()
    if rows:
        rows = np.array(sorted(tuple(r) for r in rows))
        model.logistic = _logistic(rows[:, :2], rows[:, 2])
    return model


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "doc_id long, score double, predicted int")


def rate_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """Fit on labelled rows outside the held-out fold and score all: doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels.where(~in_fold(F.col("doc_id"), folds, held)), **options))
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
