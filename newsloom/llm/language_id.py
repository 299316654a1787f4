"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams of letters (n = 1 to 4, with word borders) present in both, over the
geometric mean of how many each has: a blended-spectrum presence kernel. N-grams are numbered by a hash of 18 bits: two
n-grams share a number with probability 4e-6, so of the some 5,000 n-grams of 1,000 words 1 % fall together, of the
40,000 of 20,000 words 7 %; presence can only be added by that, alike for every language.
A few landmark texts per language give Nystroem features K(x, Z) K(Z, Z)^-1/2; ridge regression on them, one language
against the rest, is solved from sums of small matrices that tasks build over the sample. As the kernel is linear in the
presence vector, scoring is one product of a batch's sparse presence matrix with a (n-grams x languages) matrix.

Fitted on a bounded sample of distinct labelled texts: at most `fit_rows` of each language, those of the smallest hashes
of the text, each also cut to its first words so that short texts are learnt; `landmarks` of them per language. All rows
are scored. Every language is learnt; more than `max_languages` of them are refused with an error, as the matrices that
the driver solves grow with their number.

Defined cases: a null text and one without a letter get `und` with score 0; if no language can be learnt every row is
`und`; ties go to the first language by code point; equal texts get equal rows, whatever their ids, and teach once for
each language they are marked with; null and repeated ids are like others; an empty table gives no rows; whole texts are
read, whatever their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.memory import releasing
from newsloom.plans.staging import stage

ORDERS = (1, 2, 3, 4)
BITS = 18
FIT_ROWS, LANDMARKS = 1500, 40
RIDGE = 1e-3
SNIPPETS = (2, 6, 20)
MAX_LANGUAGES = 200
#: Numbers of the table that a product takes at once.
CELLS = 2_000_000
UNKNOWN = "und"
_SPACE = np.uint32(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def present(text: str) -> np.ndarray:
    """The sorted numbers of the n-grams present in a text; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    before = np.empty_like(letter)
    before[0], before[1:] = True, letter[:-1]
    points = np.where(letter, points, _SPACE)[letter | before]
    points = np.concatenate([[_SPACE], points[int(points[0] == _SPACE) : len(points) - int(points[-1] == _SPACE)], [_SPACE]]).astype(np.uint64)
    flags = np.zeros(1 << BITS, bool)
    key = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(points):
            break
        key = (key[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _STEP
        key ^= key >> np.uint64(29)
        if n in ORDERS:
            flags[(key * _STEP >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(flags)


def kernel(rows: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """Kernel values of rows against landmarks, one product per landmark column of presence."""
    place, table = _columns(landmarks)
    return _product([place[r] for r in rows], table)


def _columns(landmarks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' normalised presence as columns over the n-grams they have, and each n-gram's row (the last: none)."""
    used = np.unique(np.concatenate(landmarks))
    place = np.full(1 << BITS, len(used), np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    table = np.zeros((len(used) + 1, len(landmarks)))
    for j, z in enumerate(landmarks):
        table[place[z], j] = 1 / np.sqrt(len(z))
    return place, table


def _product(rows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The sparse matrix of normalised presence rows (given as places in table) times table, some CELLS at a time."""
    out = np.zeros((len(rows), table.shape[1]))
    sizes = np.array([len(r) for r in rows], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    turn = np.cumsum(sizes[full]) * table.shape[1] // CELLS
    for part in np.split(full, np.flatnonzero(np.diff(turn)) + 1):
        starts = np.cumsum(sizes[part]) - sizes[part]
        products = np.add.reduceat(table[np.concatenate([rows[i] for i in part])], starts, axis=0)
        out[part] = products / np.sqrt(sizes[part])[:, None]
    return out


def _pieces(text: str) -> list[str]:
    words = text.split()
    return [text, *[" ".join(words[:n]) for n in SNIPPETS if n < len(words)]]


def in_fold(key: Column, folds: int, held: int) -> Column:
    """True where crc32 of the key as text leaves `held` when divided by `folds`."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == held


def _smallest(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """lang, text: of each language the distinct texts with the `most` smallest hashes; only their hashes are ranked."""
    key = F.xxhash64(F.lit(salt), "text")
    first = W.partitionBy("lang").orderBy("key")
    keys = rows.select("lang", key.alias("key")).distinct().withColumn("at", F.row_number().over(first)).where(F.col("at") <= most)
    keys = stage(keys.select(F.col("lang").alias("l"), F.col("key").alias("k")), "language-draw")
    found = rows.withColumn("k2", key).join(F.broadcast(keys), (F.col("lang") == F.col("l")) & (F.col("k2") == F.col("k")))
    return found.select("lang", "text", "k").dropDuplicates(["lang", "k"]).select("lang", "text")


class LanguageModel:
    """languages and the (n-grams x languages) matrix whose product with a presence row gives the scores."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def known(self, text: str | None) -> float:
        """The share of the text's n-grams that some landmark has."""
        row = present(text) if text else np.empty(0, np.int64)
        return float(self.weights[row].any(1).mean()) if len(row) and self.languages else 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows = [present(t) if t else np.empty(0, np.int64) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(rows), [0.0] * len(rows)
        scores = _product(rows, self.weights)
        best = scores.argmax(1)
        confidence = np.clip((scores[np.arange(len(rows)), best] + 1) / 2, 0, 1) if len(rows) else []
        return [self.languages[b] if len(r) else UNKNOWN for b, r in zip(best, rows)], [float(c) if len(r) else 0.0 for c, r in zip(confidence, rows)]


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learn from rows of docs (doc_id, text, lang) with a text and a lang; the caller keeps held-out rows away.

    The max_languages values of lang with most rows are learnt (of equals the first by code point): a bound on the model,
    which is broadcast. Rows with rarer values, such as wrong tags, are left out of the sample, and scored like all.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    often = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    languages = sorted(r["lang"] for r in often.collect())
    usable = usable.where(F.col("lang").isin(languages))
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.float64))
    sample = _smallest(usable, fit_rows, "fit").repartition(8, F.xxhash64("text"))
    as_presence = "lang string, grams array<int>"

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [present(t.as_py()).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["lang", "grams"])

    chosen = _smallest(usable, landmarks, "landmark").mapInArrow(releasing(grams), as_presence).collect()
    by_lang = {k: sorted((r["grams"] for r in chosen if r["lang"] == k), key=lambda g: (len(g), g)) for k in languages}
    marks = [np.array(g) for k in languages for g in by_lang[k]]
    if not marks:
        return LanguageModel(languages, np.zeros((1 << BITS, len(languages)), np.float64))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    shared = docs.sparkSession.sparkContext.broadcast((marks, root, languages))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, root, languages = shared.value
        place, table = _columns(marks)
        gram, right, n = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages))), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = [(t, k) for t, k in zip(*(c.slice(at, 50).to_pylist() for c in batch.columns))]
                rows = [(place[g], k) for t, k in part for g in map(present, _pieces(t)) if len(g)]
                if rows:
                    features = _product([r for r, _ in rows], table) @ root
                    sign = np.array([[1.0 if k == own else -1.0 for k in languages] for _, own in rows])
                    gram += features.T @ features
                    right += features.T @ sign
                    n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["gram", "rights", "n"])

    parts = sample.select("text", "lang").mapInArrow(releasing(sums), "gram binary, rights binary, n long").collect()
    size = root.shape[1]
    gram = sum(np.frombuffer(p["gram"]).reshape(size, size) for p in parts)
    right = sum(np.frombuffer(p["rights"]).reshape(size, len(languages)) for p in parts)
    n = sum(p["n"] for p in parts)
    alpha = root @ np.linalg.solve(gram + ridge * max(1, n) * np.eye(size), right)
    weights = np.zeros((1 << BITS, len(languages)), np.float64)
    for z, a in zip(marks, alpha):
        weights[z] += (a / np.sqrt(len(z)))
    return LanguageModel(languages, weights)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """Fit on the rows outside the held-out fold and predict all: doc_id, held_out, lang_pred, score."""
    out = predict(docs, fit(docs.where(~in_fold(F.col("doc_id"), folds, held)), **options))
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, least_known: float = 0.3, least_score: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that some learnt language claims.

    Rejected are `und`, texts of whose n-grams the landmarks know less than least_known (an unlearnt script: a text in a
    learnt language has nearly all its shorter n-grams there), and texts with a score below least_score. Below 0.5 every
    one-against-rest output is negative; texts that mix languages come down to about 0.35 and stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(at).to_pylist()
                names, scores = shared.value.predict(texts)
                claimed = [n != UNKNOWN and s >= least_score for n, s in zip(names, scores)]
                # a claim with a clear margin needs no second look
                yield part.filter(pa.array([c and (s >= 0.75 or shared.value.known(t) >= least_known) for c, s, t in zip(claimed, scores, texts)], pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
