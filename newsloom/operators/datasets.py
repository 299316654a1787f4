"""Checks of evaluation records: duplicates, leakage between splits over everything that records share, and assignments.

Records: pair_id (long), event_id, split, gold (0 or 1), dataset_version, and for each side x (a, b) claim_x_id,
article_x_id, canonical_x_id, hash_x and text_key_x; null where unknown. Problems come as rows, all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.graph import shared_token_components
from newsloom.plans.staging import stage

SIDES = ("a", "b")
UNASSIGNED = "unassigned"


def resource_tokens() -> Column:
    """What a record rests on: its event, claims, articles (and those they copy), their hashes and the claims' texts."""
    named = [F.when(F.col("event_id") != UNASSIGNED, F.concat(F.lit("event:"), F.col("event_id")))]
    for side in SIDES:
        for kind, column in (("claim", f"claim_{side}_id"), ("article", f"article_{side}_id"), ("article", f"canonical_{side}_id"), ("hash", f"hash_{side}"), ("text", f"text_key_{side}")):
            named.append(F.concat(F.lit(f"{kind}:"), F.col(column).cast("string")))
    return F.array(*named)


def record_groups(records: DataFrame) -> DataFrame:
    """(pair_id, component): records that share a resource, directly or through others; the lowest pair names the group."""
    return shared_token_components(records.select("pair_id", resource_tokens().alias("tokens")).groupBy("pair_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens")), "pair_id", F.col("tokens"))


def _rows(df: DataFrame, problem: str, subject: Column, n: Column) -> DataFrame:
    return df.select(F.lit(problem).alias("problem"), subject.cast("string").alias("subject"), n.cast("long").alias("n"))


def split_support(records: DataFrame, groups: DataFrame, splits: list[str]) -> DataFrame:
    """(split, pairs, positive, negative, events, groups), a row for each split even without records."""
    named = records.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    counted = records.join(groups, "pair_id").groupBy("split").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("gold") == 1).alias("positive"), F.count_if(F.col("gold") == 0).alias("negative"), F.count_distinct("event_id").alias("events"), F.count_distinct("component").alias("groups")
    )
    return named.join(counted, "split", "left").na.fill(0)


def validate_dataset(records: DataFrame, vote_ids: DataFrame, splits: list[str], floor: int = 2) -> DataFrame:
    """(problem, subject, n) for everything that makes records unfit: pairs that repeat, in either order, votes (vote_id)
    counted twice, several versions, groups of connected records in several splits, and splits with fewer than `floor`
    positives, negatives or groups."""
    records = stage(records, "records")
    groups = stage(record_groups(records), "record-groups")
    key = F.concat_ws(":", F.least("claim_a_id", "claim_b_id").cast("string"), F.greatest("claim_a_id", "claim_b_id").cast("string"))
    n = F.col("n")
    several = lambda df, by: df.groupBy(by.alias("k")).agg(F.count("*").alias("n")).where("k is not null and n > 1")
    found = _rows(several(records, F.col("pair_id")), "repeated pair", F.col("k"), n)
    found = found.unionByName(_rows(several(records.where("claim_a_id is not null and claim_b_id is not null"), key), "same claims", F.col("k"), n))
    found = found.unionByName(_rows(several(vote_ids, F.col("vote_id")), "repeated vote", F.col("k"), n))
    versions = records.agg(F.count_distinct("dataset_version").alias("n"), F.count("*").alias("rows"))
    found = found.unionByName(_rows(versions.where("n <> 1 and rows > 0"), "versions", F.lit("dataset_version"), n))
    found = found.unionByName(_rows(versions.where("rows = 0"), "no records", F.lit(""), F.col("rows")))
    crossing = records.join(groups, "pair_id").groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1")
    found = found.unionByName(_rows(crossing, "leakage", F.col("component"), n))
    thin = split_support(records, groups, splits).withColumn("n", F.least("positive", "negative", "groups")).where(n < floor)
    return found.unionByName(_rows(thin, "support", F.col("split"), n))


def validate_assignments(records: DataFrame, changes: DataFrame) -> DataFrame:
    """(problem, subject, n) for changes (pair_id, split, event_id) of splits: pairs assigned twice, unknown pairs, pairs
    that are frozen elsewhere, and, once the other changes are made, groups of connected records that a change touches
    and that are assigned in part, or to several splits or events. Groups have the names of the records after the changes."""
    changes = stage(changes.select("pair_id", F.col("split").alias("new_split"), F.col("event_id").alias("new_event")), "split-changes")
    twice = changes.groupBy("pair_id").agg(F.count("*").alias("n")).where("n > 1")
    known = records.select("pair_id", "split", "event_id")
    unknown = changes.join(known, "pair_id", "left_anti").groupBy("pair_id").agg(F.count("*").alias("n"))
    met = changes.join(known, "pair_id").where(F.col("split") != UNASSIGNED)
    frozen = stage(met.where(~F.col("new_split").eqNullSafe(F.col("split")) | ~F.col("new_event").eqNullSafe(F.col("event_id"))).groupBy("pair_id").agg(F.count("*").alias("n")), "frozen-pairs")
    made = changes.join(twice, "pair_id", "left_anti").join(frozen, "pair_id", "left_anti")
    after = records.join(made, "pair_id", "left").withColumns({"split": F.coalesce("new_split", "split"), "event_id": F.coalesce("new_event", "event_id")}).drop("new_split", "new_event")
    after = stage(after, "assigned-records")
    groups = stage(record_groups(after), "assigned-groups")
    touched = groups.join(changes.select("pair_id").distinct(), "pair_id", "left_semi").select("component").distinct()
    open_ = (F.col("split") == UNASSIGNED) | (F.col("event_id") == UNASSIGNED)
    sums = after.join(groups, "pair_id").join(touched, "component", "left_semi").groupBy("component").agg(
        F.count_if(open_).alias("open"), F.count_distinct("split").alias("splits"), F.count_distinct("event_id").alias("events")
    )
    found = [_rows(df, problem, F.col("pair_id"), F.col("n")) for df, problem in ((twice, "assigned twice"), (unknown, "unknown pair"), (frozen, "frozen"))]
    found.append(_rows(sums.where("open > 0"), "assigned in part", F.col("component"), F.col("open")))
    found.append(_rows(sums.where("open = 0 and (splits > 1 or events > 1)"), "crosses", F.col("component"), F.greatest("splits", "events")))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out
