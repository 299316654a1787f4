"""Texts that are a known licence, found by digest.

A text is put in a canonical form (case, copyright lines, equivalent spellings, punctuation and white space no longer
matter), its SHA-256 digest is taken, and whole texts are joined by digest to the digests of known licences, which pass
through the same expressions. Known texts are a constant of this package, beside digests of long licences, or a table of
the caller's.

Defined cases: a null text has a null digest and no licence; an empty text and one of punctuation or copyright lines
only has the digest of the empty string and no licence; equal texts get equal rows; very long texts are read whole; an
empty table gives no row; null and repeated ids keep a row each; of known texts with one canonical form the smallest id
counts; other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.license_texts import KNOWN_DIGESTS, KNOWN_TEXTS

#: A line that only names a holder: copyright, (c) or the sign, with a year, sign or colon; or the reservation of rights.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|:|<)|\(c\)[ \t]|©)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
#: Spellings that licence texts use for one another; the left one becomes the right one.
EQUIVALENT = [
    ("https", "http"),
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("&", " and "),
]
#: White space and punctuation, which become one blank.
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}\x{AB}\x{BB}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2026}]+"
MAX_KNOWN = 20_000


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for left, right in EQUIVALENT:
        out = F.replace(out, F.lit(left), F.lit(right))
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(license_id, known_digest), one row per digest. texts: (license_id, text); None: the fixed texts and digests."""
    given = texts is not None
    if not given:
        texts = spark.createDataFrame(sorted(KNOWN_TEXTS.items()), "license_id string, text string")
    named = texts.where(F.length(canonical(F.col("text"))) > 0).select("license_id", digest(F.col("text")).alias("known_digest"))
    if not given:
        named = named.union(spark.createDataFrame(sorted(KNOWN_DIGESTS.items()), named.schema))
    return named.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, texts: DataFrame | None = None, max_known: int = MAX_KNOWN) -> DataFrame:
    """doc_id, text_digest, license_id (null: none known), is_license for each row.

    The known side is broadcast up to max_known rows by count, else joined by a shuffle of digests; texts never move.
    """
    known = known_digests(docs.sparkSession, texts)
    rows = docs.select("doc_id", digest(F.col("text")).alias("text_digest"))
    if texts is None or known.count() <= max_known:
        known = F.broadcast(known)
    joined = rows.join(known, rows["text_digest"] == known["known_digest"], "left")
    return joined.select("doc_id", "text_digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))
