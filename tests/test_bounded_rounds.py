"""Searches and selections that take few rounds on hubs, long chains and full buckets."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import inquiry, ranking


def plain_greedy(pairs, cap, used=None):
    used, taken = dict(used or {}), []
    for a, b in pairs:
        if used.get(a, 0) < cap and used.get(b, 0) < cap:
            taken.append((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return taken


def count_stages(monkeypatch, module):
    staged = []
    real = module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: staged.append(name) or real(df, name))
    return staged


def test_a_path_of_100000_pairs_in_few_rounds(spark, monkeypatch):
    staged = count_stages(monkeypatch, ranking)
    n = 100_000
    path = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("id").alias("turn")).repartition(5)
    taken = {(r["a"], r["b"]) for r in ranking.capped_pairs(path, ["turn"], 1).collect()}
    assert taken == {(k, k + 1) for k in range(0, n, 2)}
    assert len(staged) < 20


@pytest.mark.parametrize(("cap", "block", "seed"), [(1, 500_000, 1), (2, 500_000, 2), (2, 9, 3), (3, 4, 4)])
def test_capped_pairs_equal_one_pass(spark, monkeypatch, cap, block, seed):
    """A small block leaves parts of a component open for the next round."""
    monkeypatch.setattr(ranking, "BLOCK_PAIRS", block)
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)} | {(k, k + 1) for k in range(100, 140)})
    order = sorted(pairs, key=lambda p: (p[0] >= 100, p[0] if p[0] >= 100 else rng.random()))
    frame = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(order)], "a long, b long, turn int").repartition(3)
    used = {3: 1, 7: cap, 110: 1, 999: 5}
    got = {(r["a"], r["b"]) for r in ranking.capped_pairs(frame, ["turn"], cap, spark.createDataFrame(list(used.items()), "id long, used long")).collect()}
    assert got == set(plain_greedy(order, cap, used))
    assert {(r["a"], r["b"]) for r in ranking.capped_pairs(frame, ["turn"], cap).collect()} == set(plain_greedy(order, cap))


@pytest.mark.parametrize("at_once", [7, 10_000])
def test_buckets_are_filled_from_slices(spark, monkeypatch, at_once):
    """One id is in a third of all pairs; it is full after two of them, and later slices do not meet it again."""
    monkeypatch.setattr(ranking, "SLICE_PAIRS", at_once)
    rng = random.Random(9)
    pairs = sorted({tuple(sorted((0 if rng.random() < 0.33 else rng.randrange(60), rng.randrange(60, 120)))) for _ in range(400)})
    rows = [(a, b, rng.choice("xy"), rng.random() < 0.5) for a, b in pairs]
    frame = spark.createDataFrame(rows, "a long, b long, bucket string, same_outlet boolean")
    hashed = {(r["a"], r["b"]): r["h"] for r in frame.select("a", "b", F.xxhash64(F.lit("pairs"), "a", "b").alias("h")).collect()}
    used, want = {}, set()
    for name in "xy":
        order = sorted(((s, hashed[a, b], a, b) for a, b, bucket, s in rows if bucket == name))
        part = plain_greedy([(a, b) for *_, a, b in order], 2, used)[:20]
        for a, b in part:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        want |= set(part)
    assert {(r["a"], r["b"]) for r in ranking.bucketed_pairs(frame, list("xy"), 20).collect()} == want


def plain_lineage(edges, root, hops, versions, most):
    """(versions in the order of the walk, truncated)."""
    near = {}
    for a, b, s in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = max(s, near.get(a, {}).get(b, 0))
    seen, front, far = {root}, [root], 0
    for hop in range(1, hops + 1):
        front = sorted({b for a in front for b in near.get(a, {})} - seen)
        seen |= set(front)
        far = hop if front else far
    chosen, queue = [root], [(root, 0)]
    while queue and len(chosen) < versions:
        node, hop = queue.pop(0)
        for other in sorted(near.get(node, {}), key=lambda x: (-near[node][x], x)):
            if hop < hops and other not in chosen and len(chosen) < versions:
                chosen.append(other)
                queue.append((other, hop + 1))
    return (set(chosen), len(seen) > len(chosen) or len(seen) >= most or far == hops) if len(seen) > 1 else None


@pytest.mark.parametrize("most", [400, 30])
def test_lineages_of_a_hub_stop_at_the_budget(spark, monkeypatch, most):
    rng = random.Random(1)
    edges = [(1, k, rng.random()) for k in range(2, 900)] + [(k, k + 2000, rng.random()) for k in range(2, 40)] + [(5000, 5001, 0.5), (5001, 5002, 0.4), (6000 + 0, 6000, 0.1)]
    roots = [1, 2, 3, 2003, 500, 5000, 5002, 6000]
    frontiers = []
    real = inquiry.stage

    def watched(df, name):
        out = real(df, name)
        if name == "lineage-reach":
            frontiers.append(out.groupBy("root").count().agg(F.max("count").alias("m")).first()["m"] or 0)
        return out

    monkeypatch.setattr(inquiry, "stage", watched)
    frame = spark.createDataFrame(edges, "a long, b long, score double")
    times = spark.createDataFrame([(k, k) for k in range(7000)], "node long, published_s long")
    found = inquiry.lineages(frame, times, spark.createDataFrame([(r,) for r in roots], "root long"), most=most).collect()
    got = {}
    for r in found:
        got.setdefault(r["root"], (set(), r["truncated"]))[0].add(r["node"])
    want = {r: w for r in roots if (w := plain_lineage([e for e in edges if e[0] != e[1]], r, 3, 12, most))}
    assert got == want and max(frontiers) <= most


def test_many_rows_are_attached_without_broadcast_and_only_hot_keys_are_repeated(spark):
    """Spark takes a table that is repeated for each salt to be as small as its file, and would send it to the driver."""
    from newsloom.plans.staging import attach, stage

    big = spark.range(3000).select("id", F.when(F.col("id") % 50 != 7, F.when(F.col("id") < 1000, 5).otherwise(F.col("id") % 400)).alias("k"))
    small = stage(spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 10).alias("v")), "small")
    joined = attach(big, small, ["k"], "id", max_broadcast_rows=100, hot_rows=200)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Generate explode(sequence(0, CASE WHEN __hot" in plan
    want = {r["id"]: 0 if r["k"] is None else r["k"] * 10 if 0 < r["k"] < 300 else None for r in big.collect()}
    assert {r["id"]: r["v"] for r in joined.collect()} == want and joined.count() == 3000
    assert joined.columns == ["id", "k", "v"]


def test_blocks_keep_the_best_parents_of_each_child(spark):
    """Equal vectors tie to the lower id; rows of the best of each block include the best of all."""
    from newsloom.operators import vectors

    rng = random.Random(9)
    some = [[rng.random() - 0.3 for _ in range(5)] for _ in range(9)]
    rows = [(i, i % 2, rng.randrange(60), rng.choice(some) if i % 13 else None) for i in range(120)] + [(200, 0, 70, [1.0, None]), (201, 0, 71, [1.0])]
    table = spark.createDataFrame(rows, "id long, topic int, published_s long, v array<double>")
    best = lambda df, n: sorted(tuple(r) for c in {r["child"] for r in df} for r in sorted((r for r in df if r["child"] == c), key=lambda r: (-r["score"], r["parent"]))[:n])
    whole = vectors.earlier_candidates(table, 20, 0.1).collect()
    for block_rows in (4, 4_000):
        few = vectors.earlier_candidates(table, 20, 0.1, block_rows, most=2).collect()
        assert best(few, 2) == best(whole, 2) and len(few) <= len(whole)
    assert len(few) < len(whole)
