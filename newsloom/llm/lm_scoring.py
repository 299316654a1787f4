"""Cross-entropy difference under a target and a background language model.

Both models are word n-gram models of one order over one vocabulary: the target's words and the common words of all
documents, lower-cased, and one class for all others. (Common are words that make up at least one in `COMMON` of the
documents' words; target words below one in `MAX_WORDS` of the target's fall into the class of others. This bounds the
vocabulary, the only thing broadcast.) Both use one smoothing: at order k a word's probability is
(count + strength * probability at order k - 1) / (context count + strength). At order 0 it is the word's share of target
and documents together, the same for both models, with as much strength at order 1 as the target has different words:
so words that the target lacks, and the class of others, have probability under both. The target model is counted over
the target texts, the background model over all documents; a document is scored by the background's counts without its
own, so that no document vouches for itself (the shares of order 0 hold them, alike for both). A document's score is the mean over its words of
-log p_target + log p_background: the lower, the more like the target.

The corpus is dealt into chunks by a hash of id and text; rows that are equal in both are dealt one by one, so copies,
however many, do not meet in one chunk. A chunk's task counts its own n-grams and returns each once;
sums over all chunks make the background counts, which grow with the corpus. Counts and target probabilities are joined
and aggregated as tables, one order after the other. Each chunk then receives those of its own n-grams and scores its
documents. Counts are never broadcast or held whole by a task: a task holds one chunk and that chunk's n-grams.

Defined cases: null texts and texts without words have no tokens and null scores, and count for nothing; an empty target
leaves the common words of the documents; very long texts are counted and scored whole; copies vouch for one another, so equal
texts get equal scores; rows with equal or null ids are scored each by its own text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.memory import releasing
from newsloom.llm.word_hashes import word_hashes
from newsloom.plans.staging import stage

ORDER = 2
STRENGTH = 4.0
#: Bits of a word's number in an n-gram (orders up to 3 fit), the number that stands before a text, and that of other words.
BITS, BEFORE, OTHER = 20, 0, 1
MAX_WORDS = 500_000
#: Words of the documents that make up at least one in so many of them are in the vocabulary.
COMMON = 1_000
#: Bytes of text in a chunk, and those that are counted or looked up at once.
CHUNK_BYTES, PIECE_BYTES = 24_000_000, 3_000_000


def vocabulary(texts: DataFrame, most: int = MAX_WORDS) -> np.ndarray:
    """Sorted hashes of the words of texts that make up at least one in `most` of their words: never more than `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.unique(np.concatenate([word_hashes(t) for t in part]), return_counts=True) for part in _pieces(batch.column(0).to_pylist())]
            found, n = _merged(seen)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    full = texts.where("octet_length(text) > 0").select(F.lower("text").cast("binary").alias("data"))
    counts = stage(full.mapInArrow(releasing(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / most
    words = counts.where(F.col("n") >= least).toPandas()["word"].to_numpy(np.int64)
    return np.sort(words.view(np.uint64))


def word_grams(texts: list[bytes], words: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram ending at each word of each text, as an integer, and how many words each text has."""
    numbers, sizes = [], []
    for text in texts:
        own = word_hashes(text)
        at = np.minimum(np.searchsorted(words, own), max(0, len(words) - 1))
        known = words[at] == own if len(words) else np.zeros(len(own), bool)
        numbers.append(np.concatenate([np.full(order - 1, BEFORE), np.where(known, at + OTHER + 1, OTHER)]))
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    if len(flat) < order:
        return np.empty(0, np.int64), sizes
    grams = np.zeros(len(flat) - order + 1, np.int64)
    for k in range(order):
        grams = (grams << BITS) | flat[k : len(flat) - order + 1 + k]
    text = np.repeat(np.arange(len(sizes)), sizes + order - 1)
    return grams[text[: len(grams)] == text[order - 1 :]], sizes


def _pieces(texts: list[bytes], most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _merged(seen: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in seen]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in seen]), len(grams)).astype(np.int64)


def deal(rows: DataFrame, chunks: int) -> DataFrame:
    """rows (doc_id, data) with their chunk, a hash of both; rows that occur several times are dealt one by one.

    Those are found by digests, with partial counts before the shuffle, and are written with their chunks, so that
    every reading of the table finds each row in the same chunk.
    """
    chunk = lambda *key: F.pmod(F.xxhash64(F.lit("chunk"), *key), F.lit(chunks)).cast("int")
    keys = rows.groupBy("doc_id", F.md5("data").alias("digest")).agg(F.count("*").alias("n")).where("n > 1")
    again = stage(keys.select(F.col("doc_id").alias("id"), "digest"), "lm-copies")
    if again.isEmpty():
        return rows.withColumn("chunk", chunk("doc_id", "data"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.md5("data") == F.col("digest"))
    copies = stage(rows.join(again, same, "left_semi").withColumn("chunk", chunk(F.monotonically_increasing_id())), "lm-copied-rows")
    return rows.join(again, same, "left_anti").withColumn("chunk", chunk("doc_id", "data")).unionByName(copies)


def chunk_counts(chunked: DataFrame, words: np.ndarray, order: int = ORDER) -> DataFrame:
    """(chunk, gram, n) for each n-gram of each chunk; chunked (chunk, data) is partitioned by chunk."""
    shared = chunked.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            chunks = np.array(batch.column(0))
            for c in np.unique(chunks):
                texts = batch.column(1).take(pa.array(np.flatnonzero(chunks == c))).to_pylist()
                for part in _pieces(texts):
                    own = seen.setdefault(int(c), [])
                    own.append(np.unique(word_grams(part, shared.value, order)[0], return_counts=True))
                    if len(own) > 4:
                        seen[int(c)] = [_merged(own)]
        for c, own in seen.items():
            grams, n = _merged(own)
            for at in range(0, len(grams), 100_000):
                g = grams[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), c), pa.int32()), pa.array(g, pa.int64()), pa.array(n[at : at + 100_000], pa.int64())], names=["chunk", "gram", "n"])

    return chunked.select("chunk", "data").mapInArrow(run, "chunk int, gram long, n long")


def model_table(counts: DataFrame, strengths: list[float]) -> DataFrame:
    """(gram, base, aim, back) from counts (gram, t, b) of the highest order: the last word's share of target and documents,
    log p_target of it, and for each order from 1 the background's count of the n-gram that ends there and that of its
    context. There is a strength for each order."""
    order = len(strengths)
    last = lambda k: F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = stage(tables[k + 1].groupBy(last(k).alias("gram")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")), f"lm-order-{k}")
    known = None
    for k in range(1, order + 1):
        sums = tables[k].groupBy(F.shiftright("gram", BITS).alias("c")).agg(F.sum("t").alias("ct"), F.sum("b").alias("cb"))
        table = tables[k].join(sums, F.shiftright("gram", BITS) == F.col("c"))
        if known is None:
            share = (F.col("t") + F.col("b")) / (F.col("ct") + F.col("cb"))
            table = table.withColumns({"q": share, "base": share, "lower": F.array().cast("array<bigint>")})
        else:
            table = table.join(known, last(k - 1) == F.col("suffix"))
        q = (F.col("t") + strengths[k - 1] * F.col("q")) / (F.col("ct") + strengths[k - 1])
        known = table.select(F.col("gram").alias("suffix"), "base", q.alias("q"), F.concat("lower", F.array("b", "cb")).alias("lower"))
        known = stage(known, f"lm-model-{k}")
    return known.select(F.col("suffix").alias("gram"), "base", F.log("q").alias("aim"), F.col("lower").alias("back"))


def _own(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place, how often its n-gram occurs in its own text."""
    _, at = np.unique(grams, return_inverse=True)
    _, at, n = np.unique(at.astype(np.int64) * (int(text[-1]) + 1) + text, return_inverse=True, return_counts=True)
    return n[at]


def losses(grams: np.ndarray, sizes: np.ndarray, model: pa.Table, strengths: list[float]) -> np.ndarray:
    """-log p_target + log p_background at each word; model: gram, base, aim, back sorted by gram."""
    order = len(strengths)
    at = np.searchsorted(np.array(model["gram"]), grams)
    text = np.repeat(np.arange(len(sizes)), sizes)
    back = np.array(model["back"].combine_chunks().flatten()).reshape(-1, 2 * order)[at]
    q = np.array(model["base"])[at]
    for k in range(1, order + 1):
        tail = grams & ((1 << BITS * k) - 1)
        count, context = back[:, 2 * k - 2] - _own(tail, text), back[:, 2 * k - 1] - _own(tail >> BITS, text)
        q = (count + strengths[k - 1] * q) / (context + strengths[k - 1])
    return np.log(q) - np.array(model["aim"])[at]


def _score(docs: pa.Table, model: pa.Table, words: np.ndarray, strengths: list[float]) -> pa.Table:
    ids, texts = docs["doc_id"].to_pylist(), docs["data"].to_pylist()
    tokens, means = [], []
    model = model.sort_by("gram").combine_chunks()
    for part in _pieces(texts):
        grams, sizes = word_grams(part, words, len(strengths))
        tokens += sizes.tolist()
        sums = np.zeros(len(sizes))
        if len(grams):
            np.add.at(sums, np.repeat(np.arange(len(sizes)), sizes), losses(grams, sizes, model, strengths))
        means += [float(x) / n if n else None for x, n in zip(sums, sizes.tolist())]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "score": pa.array(means, pa.float64())})


def score_documents(docs: DataFrame, target: DataFrame, order: int = ORDER, strength: float = STRENGTH, chunk_bytes: int = CHUNK_BYTES, common: int = COMMON) -> DataFrame:
    """doc_id, n_tokens (words), score for each row of docs (doc_id, text); target: (text)."""
    if not 1 <= order <= 3:
        raise ValueError("orders 1 to 3 fit into one number")
    data = F.lower("text").cast("binary").alias("data")
    rows = docs.select(F.col("doc_id").cast("long"), data)
    empty = rows.where("data is null or octet_length(data) = 0").select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("score"))
    full = rows.where("octet_length(data) > 0")
    total = full.agg(F.sum(F.octet_length("data"))).first()[0]
    if not total:
        return empty
    aimed_words = vocabulary(target)
    words = np.union1d(aimed_words, vocabulary(docs, common))
    strengths = [float(max(1, len(aimed_words)))] + [strength] * (order - 1)
    chunks = max(12, -(-total // chunk_bytes))
    dealt = deal(full, chunks)
    counts = stage(chunk_counts(dealt.repartition(chunks, "chunk"), words, order), "lm-chunk-counts")
    aims = target.where("octet_length(text) > 0").select(F.pmod(F.xxhash64("text"), F.lit(8)).cast("int").alias("chunk"), data)
    aimed = chunk_counts(aims.repartition(8, "chunk"), words, order).select("gram", F.col("n").alias("t"), F.lit(0).cast("long").alias("b"))
    both = aimed.unionByName(counts.select("gram", F.lit(0).cast("long").alias("t"), F.col("n").alias("b")))
    grams = stage(both.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "lm-counts")
    model = model_table(grams, strengths)
    own = counts.select("chunk", F.col("gram").alias("g")).join(model, F.col("g") == F.col("gram")).select("chunk", "gram", "base", "aim", "back")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, shared.value, strengths)

    scored = dealt.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, score double")
    return scored.unionByName(empty)
