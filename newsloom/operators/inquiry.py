"""Questions put to the corpus for whole tables of claims: evidence checks and bounded lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import vectors, verdicts
from newsloom.operators.graph import both_ways
from newsloom.plans.staging import only, stage

MAX_CANDIDATES, LEAST_CANDIDATES = 96, 24
#: What a check warns of.
NO_EVIDENCE = "No eligible evidence was found in the bounded corpus search."
NEUTRAL = "Retrieved evidence did not establish entailment or contradiction."
NO_TIME = "Some current-corpus evidence has unknown publication time."
NO_DOMAIN = "Some evidence lacks a domain; source independence cannot be assessed."
EXTRACTED = "Some evidence uses extracted-claim text (passage_source='extracted_claim'), not an article quotation; the extraction itself is unverified."


def eligible(base: DataFrame, cutoff_s: int, historical: bool = False) -> DataFrame:
    """Rows extracted, collected and published up to the cutoff; unknown publication times only in current mode."""
    known = (F.col("extracted_s") <= cutoff_s) & (F.col("collected_s") <= cutoff_s)
    published = F.col("published_s") <= cutoff_s
    return base.where(known & (F.coalesce(published, F.lit(False)) if historical else F.coalesce(published, F.lit(True))))


def select_evidence(found: DataFrame, limit: int) -> DataFrame:
    """found (q, id, score, domain, origin, own_domain, own_origin) with `turn` from 1 to limit.

    The asker's own outlet and origin are left out, each origin counts once with its best row, and outlets take turns in
    the order in which their best rows come. Ties in score go to the lower id.
    """
    other = found.where("(own_domain is null or domain is null or domain <> own_domain) and not origin <=> own_origin")
    best = [F.desc("score"), F.col("id")]
    once = other.withColumn("r", F.row_number().over(W.partitionBy("q", "origin").orderBy(*best))).where("r = 1")
    placed = once.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(*best)))
    by_domain = W.partitionBy("q", "domain")
    turned = placed.withColumns({"round": F.row_number().over(by_domain.orderBy("place")), "first": F.min("place").over(by_domain)})
    turn = F.row_number().over(W.partitionBy("q").orderBy("round", "first"))
    return turned.withColumn("turn", turn).where(F.col("turn") <= limit).drop("r", "place", "round", "first")


def nearest_claims(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(q, score and the columns of held but v): of each claim (q, qv) the k nearest rows of held (id, v, vec) other than
    itself, ties to the lower id.

    Rows of one `vec` share a vector, which meets the claims once: the nearest k claims lie on the nearest k vectors, one
    more where the claim itself may stand alone on one. Of equal vectors those of the lower `vec` should have the lower ids.
    """
    each = held.select(F.col("vec").alias("id"), "v").dropDuplicates(["id"])
    near = vectors.nearest(asked.select("q", "qv"), each, k + 1, keep_own=True)
    met = near.select("q", F.col("id").alias("vec"), "score").join(held.drop("v"), "vec").where(F.col("id") != F.col("q"))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return met.withColumn("place", place).where(F.col("place") <= k).drop("place", "vec")


def check_claims(
    asked: DataFrame,
    base: DataFrame,
    stances: DataFrame | None,
    cutoff_s: int,
    limit: int = 6,
    least: float = 0.6,
    historical: bool = False,
    judge: Column | None = None,
    articles: DataFrame | None = None,
) -> DataFrame:
    """(q, turn, id, domain, score, stance, assessment, warnings): a row for each piece of evidence, one row without any.

    asked: (q, qv, own_domain, own_origin, q_text). base: (id, v, domain, origin, published_s, collected_s, extracted_s,
    text, article_id, vec), origin being its syndication group and vec, if it is there, the vector that several rows share.
    stances: (q, id, stance), neutral where a pair is missing, or `judge`, an expression over q_text and passage. With
    articles (article_id, content) a piece's passage is the stretch of its body that fits the claim best, and the columns
    passage and passage_source follow; without, its own text is judged. q_text, text and article_id are needed only for
    these two. Of each claim the 8 * limit (24 to 96) nearest eligible rows are candidates, those below `least` are dropped.
    """
    base = base if "vec" in base.columns else base.withColumn("vec", F.col("id"))
    held = stage(eligible(base, cutoff_s, historical).drop("collected_s", "extracted_s"), "check-base")
    k = min(MAX_CANDIDATES, max(LEAST_CANDIDATES, 8 * limit))
    found = nearest_claims(asked, held, k).where(F.col("score") >= least).join(asked.drop("qv"), "q")
    chosen = stage(select_evidence(found, limit), "check-chosen")
    shown = []
    if articles is not None:
        pairs = chosen.select(F.col("q").alias("claim_id"), F.col("q_text").alias("claim_text"), "article_id", F.col("text").alias("candidate"))
        bodies = stage(only(articles, chosen.select("article_id"), "article_id"), "check-bodies")
        chosen = chosen.join(verdicts.body_passage(pairs, bodies).toDF("q", "article_id", "passage", "passage_source"), ["q", "article_id"])
        shown = ["passage", "passage_source"]
    elif "text" in chosen.columns:
        chosen = chosen.withColumn("passage", F.col("text"))
    chosen = chosen.withColumn("stance", judge) if stances is None else chosen.join(stances, ["q", "id"], "left")
    chosen = chosen.withColumn("stance", F.coalesce("stance", F.lit("neutral")))
    chosen = stage(chosen.select("q", "turn", "id", "domain", "score", "stance", "published_s", *shown), "check-evidence")
    judged = verdicts.assessment(chosen.select(F.col("q").alias("claim_id"), "stance")).withColumnRenamed("claim_id", "q")
    extracted = F.col("passage_source") == "extracted_claim" if shown else F.lit(False)
    notes = chosen.groupBy("q").agg(
        F.bool_or(F.col("published_s").isNull()).alias("no_time"),
        F.bool_or(F.col("domain").isNull()).alias("no_domain"),
        F.bool_and(F.col("stance") == "neutral").alias("neutral"),
        F.bool_or(extracted).alias("extracted"),
    )
    warnings = F.array(
        F.when(F.col("extracted"), EXTRACTED), F.when(F.col("no_time").isNull(), NO_EVIDENCE), F.when(F.col("no_time"), NO_TIME), F.when(F.col("no_domain"), NO_DOMAIN), F.when(F.col("neutral"), NEUTRAL)
    )
    heads = asked.select("q").join(judged, "q", "left").join(notes, "q", "left")
    heads = heads.select("q", F.coalesce("assessment", F.lit("insufficient")).alias("assessment"), F.array_compact(warnings).alias("warnings"))
    rows = heads.join(chosen.drop("published_s"), "q", "left")
    return rows.select("q", "turn", "id", "domain", F.round("score", 5).alias("score"), "stance", "assessment", "warnings", *shown)


def typed_mutations(candidates: DataFrame, texts: DataFrame, evolved: float, similar: float, most: int = 50) -> DataFrame:
    """(child, parent, kind, score, types): edges of candidates (child, parent, score), the first candidate whose whole text
    says something else being the parent; types name its changes and are null for SIMILAR_TO.

    texts: (id, text). Candidates are told apart by digests of their tokens; texts meet once for each child with a parent.
    """
    said = texts.select("id", F.unhex(F.sha2(F.array_join(tx.tokens(F.col("text")), " "), 256)).alias("said"))
    edges = stage(vectors.mutation_edges(vectors.best_candidates(candidates, most), said, evolved, similar), "mutation-edges")
    pairs = edges.where("kind = 'EVOLVED_FROM'").select("child", "parent").join(texts.toDF("parent", "a"), "parent").join(texts.toDF("child", "b"), "child")
    return edges.join(verdicts.text_change(pairs).select("child", "parent", "types"), ["child", "parent"], "left")


def reach_within_budget(neighbours: DataFrame, roots: DataFrame, hops: int, most: int) -> DataFrame:
    """(root, within, far): how many nodes lie within so many hops of each root, itself included, and the farthest hop.

    A root stops at `most` nodes. neighbours: (a, b, rank), a node's neighbours numbered from 1; more than `most` of one
    node are never looked at, since fewer would stop the root too. No root has more than `most` rows in a frontier.
    """
    some = neighbours.where(F.col("rank") <= most).select("a", "b")
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        held = seen.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") < most)
        met = front.join(held.select("root"), "root", "left_semi").join(some, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        new = met.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        rank = F.row_number().over(W.partitionBy("root").orderBy("node"))
        new = new.withColumn("rank", rank).where(F.col("rank") < most).join(held, "root").where(F.col("n") + F.col("rank") <= most)
        front = stage(new.select("root", "node", F.lit(hop).alias("hop")), "lineage-reach")
        seen = seen.union(front)
    return seen.groupBy("root").agg(F.count("*").alias("within"), F.max("hop").alias("far"))


def lineages(edges: DataFrame, times: DataFrame, roots: DataFrame, hops: int = 3, versions: int = 12, most: int = 400) -> DataFrame:
    """(root, node, place, truncated): the versions of each root that has any, in order of time (unknown last, then id).

    edges: (a, b, score), taken both ways; times: (node, published_s). Versions are the root and what a breadth-first walk
    meets within so many hops, neighbours by score (then id), until there are `versions` of them; nodes that are chosen
    already are at most `versions`, so a node's best 2 * versions neighbours are enough. truncated: more nodes than that,
    or than `most`, are within reach, or some lie at the last hop, beyond which the walk does not look.
    """
    both = both_ways(edges).where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score"))
    best = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))
    neighbours = stage(both.withColumn("rank", best).where(F.col("rank") <= max(most, 2 * versions)), "lineage-neighbours")
    sizes = reach_within_budget(neighbours, roots, hops, most)
    nearest = neighbours.where(F.col("rank") <= 2 * versions)
    chosen = roots.select("root", F.col("root").alias("node"), F.lit(1).alias("pos"))
    front = chosen
    for _ in range(hops):
        met = front.join(nearest, F.col("node") == F.col("a")).select("root", F.col("b").alias("node"), F.struct("pos", (-F.col("score")).alias("s")).alias("by"))
        met = met.join(chosen.select("root", "node"), ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("by").alias("by"))
        held = chosen.groupBy("root").agg(F.count("*").alias("n"))
        rank = F.row_number().over(W.partitionBy("root").orderBy("by.pos", "by.s", "node"))
        front = met.withColumn("rank", rank).where(F.col("rank") <= versions).join(held, "root").select("root", "node", (F.col("n") + F.col("rank")).cast("int").alias("pos"))
        front = stage(front.where(F.col("pos") <= versions), "lineage-front")
        chosen = chosen.unionByName(front)
    chosen = stage(chosen, "lineage-chosen")
    kept = chosen.groupBy("root").agg(F.count("*").alias("kept"))
    cut = sizes.join(kept, "root").where("within > 1").select("root", ((F.col("within") > F.col("kept")) | (F.col("within") >= most) | (F.col("far") == hops)).alias("truncated"))
    place = F.row_number().over(W.partitionBy("root").orderBy(F.col("published_s").asc_nulls_last(), "node"))
    return chosen.join(cut, "root").join(times, "node", "left").select("root", "node", place.alias("place"), "truncated")
