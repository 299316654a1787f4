"""Dropping lines that many documents hold.

Texts are split at line ends. A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys of
at least `least_chars` code points take part. Keys are exploded as 128-bit hashes with document and position, staged,
and counted by distinct documents with partial sums before each shuffle. A key held by `least_docs` documents or more
loses its lines everywhere but in the document of the largest id. The places that a document loses come back to it as a
sorted array, and the lines between them, joined in order, are its new text. Texts are not exploded, and no task meets all
lines of a frequent key: keys with more than one in SHARES of all lines, at most SHARES of them, are broadcast, the others
meet by shuffle.

Defined cases: a null or empty text is one empty line, kept (the new text is empty); very long texts are split whole;
ids tell documents apart, so rows that repeat an id are one document; rows with a null id are none: they do not count, and
lose every line whose key is dropped anywhere; equal lines of one document count once and go or stay together; an empty
table gives an empty result; `drop_repeated_lines` keeps the caller's other columns whatever their names, except that
n_lines and n_dropped take the place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.staging import stage

LEAST_CHARS, LEAST_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARES = 20_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line in lower case (A-Z only), for a line without blanks at its ends."""
    plain = F.char_length(line) == F.octet_length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def wide_hash(value: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, t1, t2, at, h1, h2): position (from 1) and key of each line that takes part; t1 and t2 tell texts apart."""
    stripped = F.transform(lines_of(F.col("text")), lambda line: F.btrim(line, F.lit(BLANKS)))
    hashed = F.transform(stripped, lambda line, i: F.when(F.char_length(line) >= least_chars, F.struct((i + 1).alias("at"), line_key(line).alias("key"))))
    t1, t2 = wide_hash(F.col("text"))
    placed = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.explode(F.filter(hashed, lambda e: e.isNotNull())).alias("line"))
    h1, h2 = wide_hash(F.col("line.key"))
    return placed.select("doc_id", "t1", "t2", "line.at", h1.alias("h1"), h2.alias("h2"))


def repeated_keys(keys: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, last, rows): keys of at least least_docs documents, the largest id among them, and how many lines have it."""
    per_doc = keys.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("rows"))
    counted = per_doc.groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("last"), F.sum("rows").alias("rows"))
    return counted.where(F.col("docs") >= least_docs).select("h1", "h2", "last", "rows")


def lost_places(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, t1, t2, places): for each document that loses lines, the positions of these in order."""
    keys = stage(line_keys(docs, least_chars), "line-keys")
    repeated = stage(repeated_keys(keys, least_docs), "line-repeated")
    hot = F.col("rows") * SHARES >= F.lit(keys.count())
    often, seldom = (repeated.where(c).select("h1", "h2", "last") for c in (hot, ~hot))
    rest = keys.join(F.broadcast(often), ["h1", "h2"], "left_anti").join(seldom, ["h1", "h2"])
    met = keys.join(F.broadcast(often), ["h1", "h2"]).unionByName(rest)
    lost = met.where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("places"))


def kept_lines(lines: str, places: str, ends: str) -> Column:
    """The lines of a column outside its places (from 1, ascending), in order; ends: the places and one past the last line."""
    before = lambda k: F.coalesce(F.get(places, k - 1), F.lit(0))
    return F.flatten(F.transform(ends, lambda end, k: F.slice(lines, before(k) + 1, end - before(k) - 1)))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs (doc_id, text and any others) with text without its repeated lines, and n_lines (before), n_dropped."""
    lost = stage(lost_places(docs, least_chars, least_docs), "line-lost").select(F.col("doc_id").alias("d"), F.col("t1").alias("d1"), F.col("t2").alias("d2"), "places")
    t1, t2 = wide_hash(F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), t1.alias("t1"), t2.alias("t2"))
    same = rows["id"].eqNullSafe(lost["d"]) & (rows["t1"] == lost["d1"]) & (rows["t2"] == lost["d2"])
    met = rows.join(lost, same, "left").select("row", "places", lines_of(F.col("row.text")).alias("lines"))
    met = met.select("*", F.concat("places", F.array(F.size("lines") + 1)).alias("ends"))
    text = F.when(F.col("places").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept_lines("lines", "places", "ends"), "\n"))
    # the new columns are made before the caller's come back, whose names may be those used here
    new = F.struct(text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
    made = ("text", "n_lines", "n_dropped")
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return met.select("row", new.alias("new")).select(*others, *[F.col(f"new.{c}").alias(c) for c in made])
