"""Window operators: first rows per key, races, round robins, tied ranks and running counts."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.plans.staging import running_totals, stage


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def scoop_race(articles: DataFrame, edges: DataFrame, least_degree: int = 2, racers: int = 6) -> DataFrame:
    """Around each hub, dated members and the hub itself in order of time: place, lag behind the first, field and spread."""
    both = edges.select(F.col("a").alias("hub"), F.col("b").alias("member")).union(edges.select("b", "a"))
    hubs = both.groupBy("hub").agg(F.count_distinct("member").alias("degree")).where(F.col("degree") >= least_degree).select("hub")
    field = both.join(hubs, "hub", "left_semi").union(hubs.select("hub", F.col("hub").alias("member"))).distinct()
    dated = field.join(articles.where("published_s is not null").select(F.col("article_id").alias("member"), "published_s"), "member")
    fields = dated.groupBy("hub").agg(F.count("*").alias("field"), F.min("published_s").alias("first_s"), F.max("published_s").alias("last_s")).where("field >= 2")
    # The rank stands alone under its limit, so that Spark keeps the first few of a hub in each task before the shuffle.
    place = F.row_number().over(W.partitionBy("hub").orderBy("published_s", "member"))
    placed = dated.withColumn("place", place).where(F.col("place") <= racers)
    lag, spread = F.col("published_s") - F.col("first_s"), F.col("last_s") - F.col("first_s")
    return placed.join(fields, "hub").select("hub", "member", "place", lag.alias("lag_s"), "field", spread.alias("spread_s"))


def round_robin(rows: DataFrame, group: str, rank: str, limit: int) -> DataFrame:
    """One row per group and round, groups in the order in which they first appear, up to limit rows."""
    turned = rows.withColumn("round", F.row_number().over(W.partitionBy(group).orderBy(rank))).withColumn("__first", F.min(rank).over(W.partitionBy(group)))
    return turned.orderBy("round", "__first", rank).limit(limit).drop("__first")


def average_ranks(rows: DataFrame, score: str, within: list[str] | None = None) -> DataFrame:
    """Rank of each row by ascending score; tied rows share the mean of their places.

    Scores are counted first and the running sum goes over distinct scores, by range partitions where there are no groups.
    """
    within = within or []
    counts = rows.groupBy(*within, score).agg(F.count("*").alias("__n"))
    if not within:
        placed = running_totals(counts, [F.col(score)], {"__upto": "__n"})
        return rows.join(placed.select(score, (F.col("__upto") - (F.col("__n") - 1) / 2).alias("avg_rank")), score)
    upto = F.sum("__n").over(W.partitionBy(*within).orderBy(score).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.select(*within, score, (upto - (F.col("__n") - 1) / 2).alias("avg_rank"))
    return rows.join(ranked, [*within, score])


def running_confusion(rows: DataFrame, score: str = "sim_score", gold: str = "gold") -> DataFrame:
    """At each distinct score, going down: positives there (`step`), true and false positives so far."""
    counts = rows.groupBy(score).agg(F.sum(gold).cast("long").alias("step"), F.count("*").alias("n")).withColumn("m", F.col("n") - F.col("step"))
    return running_totals(counts, [F.desc(score)], {"tp": "step", "fp": "m"}).select(score, "step", "tp", "fp")


def latest_with_history(votes: DataFrame) -> DataFrame:
    """The last vote per pair and origin, the number of earlier ones and their labels in order."""
    w = W.partitionBy("pair_id", "origin").orderBy(F.desc("voted_s"), F.desc("annotator"))
    numbered = votes.withColumn("rn", F.row_number().over(w))
    last = F.max_by("label", F.when(F.col("rn") == 1, 1))
    earlier = F.sort_array(F.collect_list(F.when(F.col("rn") > 1, F.struct("voted_s", "annotator", "label"))))
    rows = numbered.groupBy("pair_id", "origin").agg(last.alias("label"), earlier.alias("h"))
    return rows.select("pair_id", "origin", "label", F.size("h").alias("revisions"), F.array_join(F.transform("h", lambda x: x["label"]), ",").alias("history"))


def next_pair(pairs: DataFrame, votes: DataFrame, uncertain_first: bool = False) -> DataFrame:
    """Per annotator, the first pair without a vote of theirs; with uncertain_first only training pairs, nearest 0.60.

    Pairs are numbered in their order; an annotator's own numbers, in order, leave the first gap where they stop being
    1, 2, 3 ... No annotator meets a pair without a vote of theirs but that one.
    """
    base = pairs.where("split = 'train'") if uncertain_first else pairs
    order = [F.abs(F.col("sim_score") - 0.6), F.col("pair_id")] if uncertain_first else [F.col("pair_id")]
    placed = stage(running_totals(base.select("pair_id", "sim_score"), order, {}).select("pair_id", "position"), "pair-positions")
    people = votes.select("annotator").distinct()
    own = votes.select("annotator", "pair_id").distinct().join(placed, "pair_id")
    turn = F.row_number().over(W.partitionBy("annotator").orderBy("position"))
    gap = own.withColumn("turn", turn).groupBy("annotator").agg(F.min(F.when(F.col("turn") != F.col("position"), F.col("turn"))).alias("gap"), F.max("turn").alias("last"))
    wanted = people.join(gap, "annotator", "left").select("annotator", F.coalesce("gap", F.col("last") + 1, F.lit(1)).alias("wanted"))
    return wanted.join(placed, F.col("wanted") == F.col("position")).select("annotator", "pair_id")


#: Open pairs of one component that a task takes at once, and of one bucket that the driver takes.
BLOCK_PAIRS, SLICE_PAIRS = 500_000, 10_000


def _tally(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("used"))


def _add(tally: DataFrame, used: DataFrame | None) -> DataFrame:
    return tally if used is None else tally.union(used.select("id", "used")).groupBy("id").agg(F.sum("used").alias("used"))


def _without_full(pairs: DataFrame, used: DataFrame | None, cap: int) -> DataFrame:
    """Pairs neither end of which is in `cap` pairs already."""
    if used is None:
        return pairs
    full = used.where(F.col("used") >= cap).select("id")
    left = pairs
    for side in ("a", "b"):
        left = left.join(full.withColumnRenamed("id", side), side, "left_anti")
    return left.select(*pairs.columns)  # a join by name puts its column first


def _greedy(pairs: Iterable[tuple[int, int]], cap: int, used: dict[int, int]) -> list[bool]:
    """Which pairs, in their order, one pass takes; used goes on counting."""
    taken = []
    for a, b in pairs:
        fits = used.get(a, 0) < cap and used.get(b, 0) < cap and (a != b or used.get(a, 0) + 1 < cap)
        if fits:
            used[a] = used.get(a, 0) + 1
            used[b] = used.get(b, 0) + 1
        taken.append(fits)
    return taken


def _first_at_both_ends(open_: DataFrame, order: list, cap: int, used: DataFrame | None) -> DataFrame:
    """Open pairs that are within the cap at both ends even if all pairs before them are taken."""
    rows = open_
    for side in ("a", "b"):
        ends = open_.withColumn("id", F.explode(F.array_distinct(F.array("a", "b"))))
        weight = F.when(F.col("a") == F.col("b"), 2).otherwise(1)
        ranked = ends.withColumn("r", F.sum(weight).over(W.partitionBy("id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).select("a", "b", "id", "r")
        rows = rows.join(ranked.select("a", "b", F.col("id").alias(f"id_{side}"), F.col("r").alias(f"r_{side}")), ["a", "b"]).where(F.col(f"id_{side}") == F.col(side))
        if used is not None:
            rows = rows.join(used.select(F.col("id").alias(f"id_{side}"), F.col("used").alias(f"u_{side}")), f"id_{side}", "left")
        else:
            rows = rows.withColumn(f"u_{side}", F.lit(0))
    fits = (F.col("r_a") + F.coalesce("u_a", F.lit(0)) <= cap) & (F.col("r_b") + F.coalesce("u_b", F.lit(0)) <= cap)
    return rows.where(fits).select(*open_.columns)


def _settle_components(open_: DataFrame, order: list, cap: int, used: DataFrame | None) -> DataFrame:
    """(a, b, fits): what one pass decides on the first BLOCK_PAIRS open pairs of each connected component.

    Components do not share ids, so each is a pass of its own. Of a larger component the pairs after its block stay open.
    """
    from newsloom.operators.components import connected_components

    groups = connected_components(open_.where("a <> b"))
    placed = open_.join(groups, F.col("a") == F.col("node"), "left").withColumn("component", F.coalesce("component", "a"))
    placed = placed.withColumn("at", F.row_number().over(W.partitionBy("component").orderBy(*order))).where(F.col("at") <= BLOCK_PAIRS)
    for side in ("a", "b"):
        if used is None:
            placed = placed.withColumn(f"u_{side}", F.lit(0).cast("long"))
        else:
            placed = placed.join(used.select(F.col("id").alias(side), F.col("used").cast("long").alias(f"u_{side}")), side, "left")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        a, b = table["a"].to_pylist(), table["b"].to_pylist()
        count = {i: u for side in ("a", "b") for i, u in zip(table[side].to_pylist(), table[f"u_{side}"].to_pylist()) if u}
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "fits": pa.array(_greedy(zip(a, b), cap, count), pa.bool_())})

    return placed.select("component", "at", "a", "b", "u_a", "u_b").groupBy("component").applyInArrow(run, "a long, b long, fits boolean")


def capped_pairs(pairs: DataFrame, order: list, cap: int, used: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) such that no id is in more than `cap` of them: those that one pass in the given order would take.

    First, rounds over the whole table: each id ranks its open pairs by the order; a pair that is within the cap still
    open at both its ends is taken, as nothing before it can fill an end; pairs with a full end are closed. In an order
    like a hash, each such round decides much of what is open. When a round decides less than a tenth (long chains, each pair
    waiting for the one before), connected components of the open pairs, which take log rounds, are settled each by one
    pass in a task, BLOCK_PAIRS of a component at a time. The order must be total. used: (id, used), pairs that ids are in
    already. Pairs are unique.
    """
    open_, taken, before = pairs, None, used
    left, by_rounds = 0, True
    while True:
        open_ = stage(_without_full(open_, before, cap), "open-pairs")
        n = open_.count()
        if n == 0:
            return taken if taken is not None else open_
        by_rounds = by_rounds and (taken is None or 10 * n <= 9 * left)
        left = n
        if by_rounds:
            new = done = stage(_first_at_both_ends(open_, order, cap, before), "taken-pairs")
        else:
            decided = stage(_settle_components(open_, order, cap, before), "settled-pairs")
            done = decided.select("a", "b")
            new = stage(open_.join(decided.where("fits").select("a", "b"), ["a", "b"], "left_semi").select(*pairs.columns), "taken-pairs")
            by_rounds = True  # what is open now has lost its heads
        if done.isEmpty():
            raise ValueError("no open pair comes first at both its ends: the order is not total")
        taken = new if taken is None else taken.union(new)
        before = stage(_add(_tally(new), before), "pair-ends")
        open_ = open_.join(done.select("a", "b"), ["a", "b"], "left_anti").select(*pairs.columns)


def bucketed_pairs(pairs: DataFrame, buckets: list[str], per_bucket: int, cap: int = 2, seed: str = "pairs", used: DataFrame | None = None) -> DataFrame:
    """Of (a, b, bucket, same_outlet, ...), up to per_bucket pairs of each bucket and cap pairs of each id.

    Buckets are filled in the order given, each from pairs of two outlets first, then by a seeded hash. What a bucket
    takes counts at its ids in later buckets. A bucket is filled from slices of its order, SLICE_PAIRS at a time, until it
    has enough: pairs with a full end go before a slice is cut, so each slice gives one pair at least, and there are at
    most per_bucket slices. used: (id, used), pairs that ids are in already.
    """
    spark = pairs.sparkSession
    order = [F.col("same_outlet"), F.xxhash64(F.lit(seed), "a", "b"), F.col("a"), F.col("b")]
    before = used
    chosen: list = []
    kept = stage(pairs, "bucket-pairs")
    for name in buckets:
        rows, own = kept.where(F.col("bucket") == name), []
        while len(own) < per_bucket:
            rows = _without_full(rows, before, cap)
            part = rows.orderBy(*order).limit(SLICE_PAIRS).select("a", "b").collect()  # SLICE_PAIRS at most
            if not part:
                break
            ends = spark.createDataFrame([(i,) for i in {x for r in part for x in (r["a"], r["b"])}], "id long")
            count = {} if before is None else {r["id"]: r["used"] for r in before.join(ends, "id").select("id", "used").collect()}
            fits = [(r["a"], r["b"]) for r, ok in zip(part, _greedy([(r["a"], r["b"]) for r in part], cap, count)) if ok][: per_bucket - len(own)]
            if not fits:
                break  # only pairs of an id with itself, for which the cap has no room
            new = spark.createDataFrame(fits, "a long, b long")
            own += fits
            before = stage(_add(_tally(new), before), "bucket-ends")
            rows = rows.join(F.broadcast(new), ["a", "b"], "left_anti").select(*pairs.columns)
        chosen += own
    return kept.join(F.broadcast(spark.createDataFrame(chosen, "a long, b long")), ["a", "b"], "left_semi").select(*pairs.columns)


def new_sample(pairs: DataFrame, existing: DataFrame, articles: DataFrame, buckets: list[str], per_bucket: int, cap: int = 2) -> DataFrame:
    """`bucketed_pairs` without pairs that exist, ids of frozen articles and ids that existing pairs fill.

    existing: (a, b, frozen); articles: (id, article_id). An article is frozen if one of its ids is in a frozen pair, and
    all its ids are frozen with it. As in a job that samples first and inserts then, what is refused is not replaced.
    """
    chosen = stage(bucketed_pairs(pairs, buckets, per_bucket, cap), "chosen-pairs")
    ends = existing.select(F.explode(F.array("a", "b")).alias("id"), "frozen")
    frozen = ends.where("frozen").join(articles, "id").select("article_id").distinct().join(articles, "article_id").select("id").distinct()
    left = chosen.join(existing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    for side in ("a", "b"):
        left = left.join(frozen.withColumnRenamed("id", side), side, "left_anti")
    filled = ends.groupBy("id").agg(F.count("*").alias("used"))
    place = {name: k for k, name in enumerate(buckets)}
    turn = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("bucket"))
    order = [turn, F.col("same_outlet"), F.xxhash64(F.lit("pairs"), "a", "b"), F.col("a"), F.col("b")]
    return capped_pairs(left.select(*chosen.columns), order, cap, filled)
