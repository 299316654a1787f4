"""Operators on edge tables: degrees, neighbourhoods, lineages, chains, components and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.components import connected_components
from newsloom.plans.staging import stage, unstage


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.count("*").alias("degree"), F.round(F.sum("score"), 6).alias("mass")).withColumnRenamed("a", "node")


def hubs(edges: DataFrame, least: int, limit: int) -> DataFrame:
    """The nodes of highest degree (then mass) of at least `least`, with their neighbours by score as one text."""
    top = degrees(edges).where(F.col("degree") >= least).orderBy(F.desc("degree"), F.desc("mass"), "node").limit(limit)
    met = both_ways(edges).join(F.broadcast(top), F.col("a") == F.col("node"))
    rows = met.groupBy("node", "degree", "mass").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "b"))).alias("n"))
    return rows.select("node", "degree", "mass", F.array_join(F.transform("n", lambda x: x["b"].cast("string")), ",").alias("neighbours"))


def within_hops(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, node, hop): nodes at most `hops` edges from each root, with the least number of edges."""
    both = stage(both_ways(edges.select("a", "b")), "both-ways")
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        reached = front.join(both, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        front = stage(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.union(front)
    return seen


def reach_profile(edges: DataFrame, roots: DataFrame, p: float, depth: int) -> DataFrame:
    """Per root: new nodes per level weighed by p to the level, with p held in .05 to .95 and depth in 1 to 6."""
    p, depth = min(0.95, max(0.05, p)), min(6, max(1, depth))
    levels = within_hops(edges, roots, depth).where("hop > 0").groupBy("root", "hop").agg(F.count("*").alias("reached"))
    return levels.groupBy("root").agg(F.sum("reached").alias("reached"), F.round(F.sum(F.col("reached") * F.pow(F.lit(p), F.col("hop"))), 6).alias("expected"))


def reach_with_fan_out(edges: DataFrame, roots: DataFrame, p: float, depth: int) -> DataFrame:
    """reach_profile for every root, with the mean number of new nodes per node that was walked from, and p times that."""
    p, depth = min(0.95, max(0.05, p)), min(6, max(1, depth))
    levels = within_hops(edges, roots, depth).groupBy("root", "hop").agg(F.count("*").alias("n"))
    new, walked = F.sum(F.when(F.col("hop") > 0, F.col("n")).otherwise(0)), F.sum(F.when(F.col("hop") < depth, F.col("n")).otherwise(0))
    expected = F.sum(F.when(F.col("hop") > 0, F.col("n") * F.pow(F.lit(p), F.col("hop"))).otherwise(0.0))
    rows = levels.groupBy("root").agg(new.alias("reached"), F.round(expected, 6).alias("expected"), (new / walked).alias("fan"))
    return rows.select("root", "reached", "expected", F.round("fan", 6).alias("fan_out"), F.round(p * F.col("fan"), 6).alias("expected_fan_out"))


def focused_timelines(edges: DataFrame, articles: DataFrame, roots: DataFrame, hops: int, members: int) -> DataFrame:
    """(root, node, place): of the nodes with an edge within so many hops of each root, the newest (undated last)."""
    from pyspark.sql import Window as W

    near = within_hops(edges, roots, hops).join(degrees(edges).select("node"), "node", "left_semi")
    dated = near.join(articles.select(F.col("article_id").alias("node"), "published_s"), "node")
    place = F.row_number().over(W.partitionBy("root").orderBy(F.col("published_s").desc_nulls_last(), "node"))
    return dated.withColumn("place", place).where(F.col("place") <= members).select("root", "node", "place")


def longest_chain(edges: DataFrame) -> DataFrame:
    """Hops of the longest parent chain over (from_id, to_id) edges.

    Pointer doubling: every node knows an ancestor and how many hops away it is; in each round it takes over the ancestor
    of its ancestor, so a chain of n hops is measured in about log2(n) rounds. A child has one parent (of several the
    lowest counts). A chain that runs into a cycle has no end and does not count: after as many rounds as the number of
    edges has binary digits, what is still on its way never ends.
    """
    step = edges.groupBy(F.col("from_id").alias("node")).agg(F.min("to_id").alias("up"), F.lit(1).cast("long").alias("hops"))
    step = stage(step.where("up is not null"), "parents")
    for _ in range(step.count().bit_length() + 1):
        if step.where("up is not null").isEmpty():
            break
        above = step.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("hops").alias("more"))
        later = step.where("up is not null").join(above, F.col("up") == F.col("at"), "left").select("node", F.col("next").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        later = stage(later.unionByName(step.where("up is null")), "chain")
        unstage(step)
        step = later
    ended = step.where("up is null").agg(F.coalesce(F.max("hops"), F.lit(0)).cast("int").alias("longest_chain"))
    return ended


def mutation_chains(claims: DataFrame, newest: int = 400, k: int = 5, least: float = 0.84, versions: int = 3, limit: int = 8) -> DataFrame:
    """(chain, place, size, outlets, version, id): how one statement wanders from outlet to outlet.

    claims: (id, v, domain, extracted_s, published_s). Each of the newest claims meets its k nearest claims of other
    outlets; pairs from `least` on chain up. Of the largest chains with so many versions, those that span outlets are
    returned, most outlets first, then largest; a chain's versions are in order of publication, undated last. The numbers
    of claims that ask and of chains that are returned are the report's own limits.
    """
    from pyspark.sql import Window as W

    from newsloom.operators.vectors import nearest

    usable = claims.where("v is not null")
    asking = stage(usable.orderBy(F.desc_nulls_last("extracted_s"), "id").limit(newest).select(F.col("id").alias("q"), F.col("v").alias("qv"), "domain"), "chain-claims")
    pairs = nearest(asking, usable.select("id", "v", "domain"), k, exclude_same="domain").where(F.col("score") >= least)
    groups = connected_components(pairs.select(F.col("q").alias("a"), F.col("id").alias("b")))
    members = stage(groups.join(claims.select(F.col("id").alias("node"), "domain", "published_s"), "node"), "chain-members")
    sized = members.groupBy("component").agg(F.count("*").alias("size"), F.count_distinct("domain").alias("outlets")).where(F.col("size") >= versions)
    largest = sized.orderBy(F.desc("size"), "component").limit(limit).where("outlets >= 2")
    placed = largest.withColumn("place", F.row_number().over(W.orderBy(F.desc("outlets"), F.desc("size"), "component")))  # at most `limit` rows
    version = F.row_number().over(W.partitionBy("component").orderBy(F.col("published_s").asc_nulls_last(), "node"))
    rows = members.join(F.broadcast(placed), "component").withColumn("version", version)
    return rows.select(F.col("component").alias("chain"), "place", "size", "outlets", "version", F.col("node").alias("id"))


def story_components(edges: DataFrame, nodes: DataFrame, least_size: int, least_domains: int) -> DataFrame:
    """Components of at least so many nodes from so many outlets: id, size, outlets. nodes: (node, domain)."""
    found = connected_components(edges).join(nodes, "node")
    rows = found.groupBy("component").agg(F.count("*").alias("size"), F.count_distinct("domain").alias("outlets"))
    return rows.where((F.col("size") >= least_size) & (F.col("outlets") >= least_domains))


def shared_token_components(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, component): rows that share a token of an array, directly or through others, fall together.

    Each token links its rows to the lowest of them, a star, so a token of many rows makes no pairs.
    """
    held = rows.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.array_compact(tokens))).alias("token"))
    first = held.groupBy("token").agg(F.min("id").alias("first"))
    links = held.join(first, "token").select(F.col("id").alias("a"), F.col("first").alias("b"))
    groups = connected_components(links)
    return rows.select(key).join(groups, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("component"))


def token_components(rows: DataFrame, key: str, token_columns: list[str]) -> DataFrame:
    """(key, component): rows that share a value of any token column, directly or through others, fall together."""
    return shared_token_components(rows, key, F.array(*[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in token_columns]))


def syndication_groups(rows: DataFrame) -> DataFrame:
    """(article_id, component, name) of articles (article_id, canonical_id, content_hash, body) that are one origin: they
    share an article, its canonical one, a hash or a body's key. The lowest canonical id, else hash, else article names it."""
    text = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    tokens = F.array(text("article", "article_id"), text("article", "canonical_id"), text("hash", "content_hash"), text("body", "body"))
    grouped = rows.join(shared_token_components(rows, "article_id", tokens), "article_id")
    name = F.coalesce(F.concat(F.lit("canonical:"), F.min("canonical_id").cast("string")), F.concat(F.lit("content:"), F.min("content_hash")), F.concat(F.lit("article:"), F.min("article_id").cast("string")))
    names = grouped.groupBy("component").agg(name.alias("name"))
    return grouped.select("article_id", "component").join(names, "component").select("article_id", "component", "name")


def around(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges among the given nodes (node) and all their neighbours, one hop away."""
    wanted = nodes.select("node").distinct()
    near = both_ways(edges.select("a", "b")).join(wanted, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node"))
    return induced(edges, wanted.union(near).distinct())


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select(*edges.columns)


def graph_quality(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Share of evolved edges whose parent is not newer, share of scores in 0 to 1, and mean out-degree; 1 without edges."""
    time = claims.select("claim_id", "published_s")
    met = relations.join(time.select(F.col("claim_id").alias("from_id"), F.col("published_s").alias("child_s")), "from_id", "left")
    met = met.join(time.select(F.col("claim_id").alias("to_id"), F.col("published_s").alias("parent_s")), "to_id", "left")
    evolved = F.col("kind") == "EVOLVED_FROM"
    valid = F.avg(F.when(evolved & F.col("child_s").isNotNull() & F.col("parent_s").isNotNull(), (F.col("parent_s") <= F.col("child_s")).cast("int")))
    return met.agg(
        F.round(F.coalesce(valid, F.lit(1.0)), 6).alias("temporal_validity"),
        F.round(F.coalesce(F.avg(F.col("score").between(0, 1).cast("int")), F.lit(1.0)), 6).alias("score_consistency"),
        F.round(F.count("*") / F.count_distinct("from_id"), 6).alias("mean_out_degree"),
    )


def two_hop_paths(edges: DataFrame) -> DataFrame:
    """(a, m, c): paths over every middle node, a < c."""
    both = both_ways(edges.select("a", "b")).select(F.col("a").alias("m"), F.col("b").alias("end"))
    left, right = both.select("m", F.col("end").alias("a")), both.select("m", F.col("end").alias("c"))
    return left.join(right, "m").where("a < c").select("a", "m", "c")


def hub_timelines(edges: DataFrame, articles: DataFrame, least: int, members: int) -> DataFrame:
    """Per hub of at least `least` edges: its newest members (undated last) in order, and the newest time."""
    from pyspark.sql import Window as W

    both = both_ways(edges.select("a", "b"))
    top = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("node"))
    met = both.join(top, F.col("a") == F.col("node")).join(articles.select(F.col("article_id").alias("b"), "published_s"), "b")
    placed = met.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.col("published_s").desc_nulls_last(), "b"))).where(F.col("r") <= members)
    rows = placed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("r", "b"))).alias("m"), F.max("published_s").alias("newest_s"))
    return rows.select("node", F.array_join(F.transform("m", lambda x: x["b"].cast("string")), ",").alias("members"), "newest_s")
