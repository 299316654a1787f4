"""Filtered neighbours, mutation chains, chains by doubling, and group bootstraps of rank metrics against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import evaluation, graph, vectors


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.fixture(scope="module")
def claims():
    rng = np.random.default_rng(5)
    return [(i, [float(x) for x in rng.standard_normal(4)], None if i % 17 == 3 else f"d{i % 3}", 100 - i // 2, None if i % 5 == 0 else 1000 - i) for i in range(90)]


SCHEMA = "id long, v array<double>, domain string, extracted_s long, published_s long"


@pytest.mark.parametrize("block", [7, 4000])
def test_neighbours_of_other_groups(spark, claims, block):
    """The k best of other outlets come back although nearer rows of the same outlet exist."""
    rows = spark.createDataFrame(claims, SCHEMA)
    found = vectors.nearest(rows.where("id % 4 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), "domain"), rows, 6, block, exclude_same="domain")
    got = {}
    for r in found.orderBy("q", "place").collect():
        got.setdefault(r["q"], []).append(r["id"])
    want = {}
    for i, v, d, *_ in claims:
        if i % 4 == 0 and d is not None:
            best = sorted((-cosine(v, w), j) for j, w, e, *_ in claims if j != i and e is not None and e != d)[:6]
            want[i] = [j for _, j in best]
    assert got == want and all(len(x) == 6 for x in got.values())


def plain_chains(claims, newest, k, least, versions, limit):
    asking = sorted(claims, key=lambda c: (-c[3], c[0]))[:newest]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v, d, *_ in asking:
        near = sorted((-cosine(v, w), j) for j, w, e, *_ in claims if j != i and d is not None and e is not None and e != d)[:k]
        for s, j in near:
            if -s >= least:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    about = {c[0]: c for c in claims}
    big = sorted((-len(m), root) for root, m in groups.items() if len(m) >= versions)[:limit]
    spans = [(-len({about[i][2] for i in groups[root]}), n, root) for n, root in big]
    out = []
    for place, (outlets, n, root) in enumerate(sorted(s for s in spans if s[0] <= -2), 1):
        order = sorted(groups[root], key=lambda i: (about[i][4] is None, about[i][4] or 0, i))
        out += [(root, place, -n, -outlets, version, i) for version, i in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize(("newest", "k", "least", "versions", "limit"), [(400, 5, 0.97, 2, 8), (30, 2, 0.9, 3, 4), (400, 1, 0.999, 2, 2)])
def test_mutation_chains(spark, claims, newest, k, least, versions, limit):
    found = graph.mutation_chains(spark.createDataFrame(claims, SCHEMA), newest, k, least, versions, limit)
    got = sorted(tuple(r) for r in found.collect())
    assert got == plain_chains(claims, newest, k, least, versions, limit)
    assert got or least > 0.99


def longest(spark, edges):
    return graph.longest_chain(spark.createDataFrame(edges, "from_id long, to_id long")).first()["longest_chain"]


def test_a_chain_of_100000_takes_few_rounds(spark, monkeypatch):
    staged = []
    real = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: staged.append(name) or real(df, name))
    n = 100_000
    edges = spark.range(1, n + 1).select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("to_id")).repartition(7)
    assert graph.longest_chain(edges).first()["longest_chain"] == n
    assert len(staged) < 20


def test_chains_that_end_and_cycles_that_do_not(spark):
    assert longest(spark, [(1, 2), (2, 3), (9, 2), (8, 9), (7, 8)]) == 4
    assert longest(spark, [(1, 2), (2, 3), (3, 1), (5, 1), (20, 21)]) == 1
    assert longest(spark, [(1, 1)]) == 0 and longest(spark, [(1, 2), (2, 1)]) == 0
    assert longest(spark, [(1, None), (2, 1)]) == 1
    assert longest(spark, [(k, k // 2) for k in range(1, 300)]) == 9  # 1 -> 0 ends it


# ---------------------------------------------------------------- bootstrap


def auroc(scores, labels):
    pairs = [(a, b) for a, y in zip(scores, labels) if y for b, z in zip(scores, labels) if not z]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


def auprc(scores, labels):
    total = last = 0.0
    for t in sorted(set(scores), reverse=True):
        tp, n = sum(1 for s, y in zip(scores, labels) if s >= t and y), sum(1 for s in scores if s >= t)
        total += (tp / sum(labels) - last) * tp / n
        last = tp / sum(labels)
    return total


def f1(scores, labels, at):
    tp = sum(1 for s, y in zip(scores, labels) if s >= at and y)
    return 2 * tp / (sum(1 for s in scores if s >= at) + sum(labels)) if sum(labels) or any(s >= at for s in scores) else 0.0


def plain_bootstrap(rows, resamples, seed, first_at, second_at):
    """rows: (group, gold, first, second)."""
    groups = sorted({r[0] for r in rows})
    members = {g: [r for r in rows if r[0] == g] for g in groups}
    measure = lambda sample: {
        name: fn([r[2] for r in sample], [r[1] for r in sample], first_at) - fn([r[3] for r in sample], [r[1] for r in sample], second_at)
        for name, fn in (("auroc", lambda s, y, _: auroc(s, y)), ("auprc", lambda s, y, _: auprc(s, y)), ("f1", f1))
    }
    found = []
    for b in range(resamples):
        drawn = [groups[int(hashlib.md5(f"{seed}:{b}:{i}".encode()).hexdigest()[:8], 16) % len(groups)] for i in range(len(groups))]
        sample = [r for g in drawn for r in members[g]]
        if any(r[1] for r in sample) and not all(r[1] for r in sample):
            found.append(measure(sample))
    interval = lambda m, q: round(float(np.quantile([f[m] for f in found], q)), 6) if len(found) >= 10 else None
    return {m: (measure(rows)[m], interval(m, 0.025), interval(m, 0.975), len(found)) for m in ("auroc", "auprc", "f1")}


@pytest.mark.parametrize(("n", "groups", "steps", "at_once"), [(200, 23, 4, 64), (60, 9, 30, 7), (14, 3, 2, 64)])
def test_group_bootstrap_equals_plain_resampling(spark, monkeypatch, n, groups, steps, at_once):
    """With few distinct scores one score fills several partitions; with few groups some resamples have one class."""
    monkeypatch.setattr(evaluation, "RESAMPLES_AT_ONCE", at_once)
    rng = random.Random(n)
    rows = []
    for _ in range(n):
        g = rng.randrange(groups)
        gold = int(g != 1 if groups == 3 else g == 0 or g % 3 > 0 and rng.random() < 0.7)
        rows.append((g, gold, rng.randint(0, steps) / steps, (rng.randint(0, steps) + gold) / steps))
    df = spark.createDataFrame([(*r, "x") for r in rows], "grp long, gold int, one double, two double, times string").repartition(5)
    found = {r["metric"]: r for r in evaluation.group_bootstrap(df, "grp", ("one", 0.5), ("two", 0.5), 25, "s").collect()}
    want = plain_bootstrap(rows, 25, "s", 0.5, 0.5)
    assert set(found) == set(want)
    for m, (observed, low, high, valid) in want.items():
        r = found[m]
        assert r["observed"] == pytest.approx(observed, abs=2e-6) and r["valid"] == valid
        assert (r["low"], r["high"]) == (pytest.approx(low, abs=2e-6), pytest.approx(high, abs=2e-6)) if valid >= 10 else (r["low"], r["high"]) == (None, None)
    if groups == 3:
        assert want["f1"][3] < 25


def test_mcnemar_p(spark):
    for b, c in [(0, 0), (1, 0), (5, 9), (3, 3), (40, 2), (10, 25)]:
        rows = [(0.6, 1)] * b + [(0.6, 0)] * c + [(0.9, 1), (0.1, 0)]
        r = evaluation.mcnemar(spark.createDataFrame(rows, "sim_score double, gold int"), F.col("sim_score") >= 0.5, F.col("sim_score") >= 0.7).first()
        stat = (abs(b - c) - 1) ** 2 / (b + c) if b + c else 0.0
        p = math.erfc(math.sqrt(stat / 2)) if stat > 0 else 1.0
        assert (r["b"], r["c"], r["statistic"]) == (b, c, round(stat, 4)) and r["p_value"] == pytest.approx(p, abs=1.1e-6)
