"""Line dedup, hard negatives and whitening against plain Python on small tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import hard_negatives, line_dedup, whitening

# ---------------------------------------------------------------- lines

DOCS = "doc_id long, text string, n_lines string, row int, places int, t1 int, key map<string,int>"


def make(spark, rows):
    """Documents with columns whose names clash with those that the operator makes."""
    return spark.createDataFrame([(i, t, "x", k, -1, -1, {"k": k}) for k, (i, t) in enumerate(rows)], DOCS)


def plain_lines(rows, least_chars=40, least_docs=5):
    """[(doc_id, n_lines, n_dropped, text)] for each row."""
    low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(line_dedup.BLANKS).translate(low)
    held = collections.defaultdict(set)
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= least_chars and i is not None:
                held[key(line)].add(i)
    often = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, lines in split:
        kept = [line for line in lines if key(line) not in often or often[key(line)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found_lines(df):
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()]


def in_order(rows):
    return sorted(rows, key=str)


def test_lines_lose_what_five_documents_hold(spark):
    line = "This Line is Held by Five Documents, ÄÖÜ too"
    rows = [(k, f"own {k}\n{line if k % 2 else chr(9) + line.lower().replace('äöü', 'ÄÖÜ') + ' '}\n\nend") for k in range(5)]
    rows += [(9, line.replace("ÄÖÜ", "äöü")), (10, line[:39]), (11, f"{line[:39]}\n" * 4)]
    got = found_lines(line_dedup.drop_repeated_lines(make(spark, rows)))
    assert in_order(got) == in_order(plain_lines(rows))
    assert {r[0]: r[2] for r in got} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 9: 0, 10: 0, 11: 0}


def test_lines_odd_rows(spark):
    line = "a line of exactly more than forty characters"
    long = "\n".join([f"own line number {k} of a very long document here" for k in range(20_000)] + [line] * 3)
    rows = [(1, None), (2, ""), (3, "\n"), (4, line), (4, line), (4, f"x\n{line}"), (5, line), (6, long), (None, line), (None, f"{line}\r\nnull id"), (7, f"{line}\n\n{line}"), (8, line), (8, line)]
    df = make(spark, rows)
    got = found_lines(line_dedup.drop_repeated_lines(df))
    assert in_order(got) == in_order(plain_lines(rows))
    kept = line_dedup.drop_repeated_lines(df)
    assert [(r["row"], r["places"], r["t1"], r["key"]) for r in kept.orderBy("row").collect()] == [(k, -1, -1, {"k": k}) for k in range(len(rows))]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_lines_of_one_document_repeated_are_no_reason(spark):
    line = "one document repeats this line many times over"
    rows = [(1, f"{line}\n" * 9), (2, line), (2, line), (3, line), (None, line), (None, f"{line}\n.")]
    assert in_order(found_lines(line_dedup.drop_repeated_lines(make(spark, rows)))) == in_order(plain_lines(rows))


@pytest.mark.parametrize("shares", [2, 20_000])
def test_lines_random(spark, monkeypatch, shares):
    """With few shares the frequent keys are broadcast and the others meet by shuffle."""
    monkeypatch.setattr(line_dedup, "SHARES", shares)
    rng = random.Random(shares)
    pool = [f"shared line {k} with words enough to be counted" for k in range(12)] + ["", " ", "short", "\t\x0b"]
    rows = [(rng.choice([k, k, k // 2]), "\n".join(rng.choices(pool, weights=[30 if j == 0 else 1 for j in range(16)], k=rng.randint(0, 9)))) for k in range(120)]
    assert in_order(found_lines(line_dedup.drop_repeated_lines(make(spark, rows)))) == in_order(plain_lines(rows))


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """rows: (id, x, label)."""
    out = []
    for q, qx, label in rows:
        if not anchors(q):
            continue
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(qx, x)), i, other) for i, x, other in rows if i != q and len(x) == len(qx)))
        for p, pid in [(-s, i) for s, i, other in scored if other == label][:positives]:
            fits = [(-s, i) for s, i, other in scored if other != label and low * p <= -100 * s <= high * p][:negatives]
            out += [(q, pid, k, i, p, s) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame([(i, x, label, 1) for i, x, label in rows], "vec_id long, x array<long>, label int, q int")
    found = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % every == 0, **more)
    assert tuple(found.columns) == COLUMNS
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize(("scale", "block"), [(3, 4096), (300, 16), (1_000_000_000, 16)])
def test_negatives_equal_brute_force(spark, monkeypatch, scale, block):
    """Small numbers tie often; numbers beyond doubles take the exact path; small blocks meet across tasks."""
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    rng = random.Random(scale)
    rows = [(i, [rng.randint(-scale // 3, scale) for _ in range(3)], rng.choice([0, 0, 1, 2])) for i in range(-20, 100)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows, lambda q: q % 10 == 0) and got
    assert mined(spark, rows, positives=2, negatives=3, low=0, high=100) == plain_negatives(rows, lambda q: q % 10 == 0, 2, 3, 0, 100)


def test_negatives_odd_rows(spark):
    rows = [(0, [10, 0], 0), (1, [9, 0], 0), (2, [5, 5], 1), (3, [8, 1], 1), (4, [1, 1, 1], 1), (10, [0, 1], 5), (20, [-5, 0], 7), (21, [5, 0], 7)]
    odd = [(None, [5, 0], 1), (6, None, 1), (7, [5, None], 1), (8, [5, 0], None), (2, [5, 5], 1)]
    assert mined(spark, rows + odd) == plain_negatives(rows, lambda q: q % 10 == 0) == [(0, 1, 1, 3, 90, 80), (0, 1, 2, 2, 90, 50), (0, 1, 3, 21, 90, 50)]
    assert mined(spark, []) == []
    assert mined(spark, [(2, [5, 5], 1), (3, [9, 9], 0)]) == []
    twice = [(0, [10], 0), (1, [10], 0), (2, [6], 1), (2, [7], 1), (2, [6], 0)]
    assert mined(spark, twice) == plain_negatives([(0, [10], 0), (1, [10], 0), (2, [6], 0)], lambda q: q % 10 == 0)


def test_negatives_beyond_longs_stop(spark):
    top = 2**62
    rows = [(0, [top, 0], 0), (1, [top, 0], 0), (2, [1, 0], 1), (3, [-top, 5], 1)]
    assert mined(spark, rows) == [(0, 1, 1, 2, 2**63 - 1, top)]


def test_finite_vectors_only(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>")
    found = {r["vec_id"]: r["x"] for r in df.select("vec_id", F.when(hard_negatives.all_finite(F.col("e")), hard_negatives.whole_numbers(F.col("e"))).alias("x")).collect()}
    assert found == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


# ---------------------------------------------------------------- whitening


def whitened(spark, rows, **more):
    df = spark.createDataFrame([(i, x, "m") for i, x in rows], "vec_id long, x array<long>, label string")
    return whitening.whiten(df, **more).collect()


def check_whitening(found, rows, components=4):
    """Everything but the sign of a component, from Python's whole numbers and numpy's eigenvectors."""
    fit = sorted({tuple(x) for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    exact = [[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) for j in range(d)] for i in range(d)]
    v = np.array([[c / n**3 for c in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    kept = [k for k in range(d - 1, -1, -1) if values[k] > 1e-12 * np.trace(v)][:components]
    assert len(found) == len(rows) * len(kept)
    by = collections.defaultdict(list)
    for r in found:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, len(kept) + 1))
    deviation = lambda x: sum((n * a - s) ** 2 for a, s in zip(x, sums))
    for c, k in enumerate(kept, 1):
        want = collections.defaultdict(list)
        for i, x in rows:
            w = sum((a * n - s) / n * e for a, s, e in zip(x, sums, vectors[:, k])) / math.sqrt(values[k])
            want[i].append((w, deviation(x)))
        top = max((abs(r["whitened"]), r["whitened"], str(r["vec_id"])) for r in by[c])
        mine = max((abs(w), w, str(i)) for i, all_w in want.items() for w, _ in all_w)
        sign = 1 if abs(top[1] - mine[1]) <= 1e-6 else -1
        for r in by[c]:
            assert r["n"] == n and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(values[k] / np.trace(v), rel=1e-9)
            assert any(r["whitened"] == pytest.approx(sign * w, abs=1e-7) and r["deviation"] == (dev if dev < 2**63 else None) for w, dev in want[r["vec_id"]])


@pytest.mark.parametrize(("scale", "d"), [(3, 3), (256, 8), (10**9, 5), (2**62, 2)])
def test_whitening_equals_plain_numbers(spark, scale, d):
    rng = random.Random(d)
    factors = [1, 0.5, 0.2, 0.1, 0.05, 0.04, 0.03, 0.02]
    rows = [(i, [int(rng.gauss(0.1, 0.3) * scale * factors[k]) for k in range(d)]) for i in range(150)]
    rows += [(900 + i, rows[i % 7][1]) for i in range(60)] + [(None, rows[3][1]), (3, rows[4][1])]
    check_whitening(whitened(spark, rows), rows)


def test_cross_products_are_exact():
    rng = np.random.default_rng(3)
    for scale, rows in ((1, 3), (2, 64), (500, 65), (2**31, 130), (2**62, 70)):
        x = rng.integers(-scale, scale + 1, (rows, 4))
        sums, products = whitening.cross_products(x)
        whole = x.astype(object)
        assert sums == list(whole.sum(0)) and (products == whole.T @ whole).all()
        for value in [int(v) for v in products.ravel()]:
            assert sum(digit << whitening.DIGIT_BITS * k for k, digit in enumerate(whitening._digits(value))) == value


def test_whitening_odd_rows(spark):
    rows = [(1, [0, 0]), (2, [4, 2]), (3, [0, 2]), (4, [4, 0]), (4, [4, 0])]
    odd = [(5, None), (6, [1, None]), (7, []), (8, [1, 2, 3])]
    found = whitened(spark, rows + odd)
    check_whitening(found, rows)
    assert {r["vec_id"] for r in found} == {1, 2, 3, 4}
    assert whitened(spark, []) == whitened(spark, odd[:3]) == whitened(spark, rows[:1] * 3) == []
    flat = [(k, [k, 2 * k, 7]) for k in range(5)]
    assert {r["component"] for r in whitened(spark, flat)} == {1}


def test_kept_text_digest(spark):
    rows = [(1, None), (2, "a\n\nb ")]
    found = {r["doc_id"]: r["d"] for r in line_dedup.drop_repeated_lines(make(spark, rows)).select("doc_id", F.sha2("text", 256).alias("d")).collect()}
    assert found == {1: hashlib.sha256(b"").hexdigest(), 2: hashlib.sha256(b"a\n\nb ").hexdigest()}
