"""A corpus pipeline in five stages, each an operator of newsloom.llm applied to all that its predecessor kept.

Defined cases, besides those of the operators: extra columns, whatever their names, stay with their rows; an empty table
stays empty; very long texts go through every stage whole. Null, empty and wordless texts and null ids pass the stages of
toxicity (nothing in them matches) and near-duplicates (they link with nothing); null texts and texts without a letter
end in the language stage; mixing repeats or leaves out what has come so far. Of rows that repeat an id and a text one
passes the stage of near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import language_id, minhash_dedup, mixing, sentencepiece_codec, toxicity
from newsloom.llm.queries import piece_model
from newsloom.plans.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from the table of labels, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~language_id.in_fold(labels["doc_id"], 5, 0)))
    return toxicity.keep_clean(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one of the languages learnt from the documents' own marks claims."""
    model = language_id.fit(docs.where(~language_id.in_fold(docs["doc_id"], 3, 1)))
    return language_id.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return minhash_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the text decoded from them."""
    return sentencepiece_codec.encode_documents(docs, piece_model(), with_text=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix),
    ("SentencePiece", tokenize),
]

#: SQL expresses neither the learnt models nor the encoder: tests/llm holds the operators against plain versions (a scan of
#: the lexicon, kernel ridge regression, all pairs, targets by hand, the library's encoder) and runs the stages on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
