"""Records of labelled pairs for export, with features, votes and consensus, and the rules that they must meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators.evaluation import quarantine, typed_consensus

SPLITS = ("train", "dev", "test")
#: The labels that a pair may have.
LABELS = ("SAME_STORY", "EVOLVED", "DISTINCT")


def pair_records(pairs: DataFrame, votes: DataFrame) -> DataFrame:
    """pairs (pair_id, event_group, split, text_a, text_b and others) with what an export says of them.

    Added: votes (array of origin, annotator, label, voted_s, in this order), n_human and n_votes; the consensus (status,
    consensus, mutation_status, mutation_types; pairs without human votes need them); lexical_jaccard, null where a text
    is null, and entity_jaccard, null where neither text has entities; excluded, the reason why the pair does not enter
    an experiment, or null. A pair's votes, one for each voter, are one row.
    """
    vote = F.struct("origin", "annotator", "label", "voted_s")
    listed = votes.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(vote)).alias("votes"), F.count_if(F.col("origin") == "HUMAN").alias("n_human"), F.count("*").alias("n_votes")
    )
    agreed = typed_consensus(votes).withColumnRenamed("label", "consensus").drop("voters")
    rows = pairs.join(listed, "pair_id", "left").join(agreed, "pair_id", "left")
    a, b = F.col("text_a"), F.col("text_b")
    known = a.isNotNull() & b.isNotNull()
    empty = F.array().cast("array<struct<origin:string,annotator:string,label:string,voted_s:bigint>>")
    rows = rows.withColumns({
        "votes": F.coalesce("votes", empty),
        "n_human": F.coalesce("n_human", F.lit(0)),
        "n_votes": F.coalesce("n_votes", F.lit(0)),
        "status": F.coalesce("status", F.lit("needs_human_votes")),
        "mutation_status": F.coalesce("mutation_status", F.lit("not_annotated")),
        "lexical_jaccard": F.when(known, tx.jaccard(tx.token_set(a), tx.token_set(b))),
        "entity_jaccard": tx.entity_jaccard(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))),
    })
    placed = F.col("event_group").isNotNull() & F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    return rows.withColumn("excluded", F.when(F.col("status") != "agreed", F.col("status")).when(~placed, "unassigned_event_or_split"))


def exclusions(records: DataFrame) -> DataFrame:
    """(reason, records): how many are left out for each reason, and how many are `selected`."""
    return records.groupBy(F.coalesce("excluded", F.lit("selected")).alias("reason")).agg(F.count("*").alias("records"))


def invalid_records(records: DataFrame) -> DataFrame:
    """Records (as from `pair_records`, with gold_label, claim_a_id, claim_b_id and sim_score) that break rules, with the
    names of all rules they break; the others are left out."""
    bad = lambda holds: ~F.coalesce(holds, F.lit(False))
    share = lambda name: F.coalesce(~F.col(name).between(0, 1) | F.isnan(name), F.lit(False))
    score, written = F.col("sim_score"), lambda name: F.length(F.trim(name)) > 0
    rules = {
        "identifier": F.col("pair_id").isNull() | F.col("claim_a_id").isNull() | F.col("claim_b_id").isNull(),
        "event_or_split": F.col("event_group").isNull() | bad(F.col("split").isin(*SPLITS)),
        "self_pair": F.col("claim_a_id") == F.col("claim_b_id"),
        "text": bad(written("text_a") & written("text_b")),
        "score": bad(score.between(-1, 1) & ~F.isnan(score)),
        "gold": bad(F.col("gold_label").isin(*LABELS)),
        "human_votes": bad(F.col("n_human") > 0),
        "consensus": bad((F.col("status") == "agreed") & (F.col("consensus") == F.col("gold_label"))),
        "feature": share("lexical_jaccard") | share("entity_jaccard"),
    }
    return quarantine(records, rules)
