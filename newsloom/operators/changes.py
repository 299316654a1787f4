"""Token-level differences of text pairs, with spans in code points."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import TOKEN
from newsloom.operators.verdicts import with_change_kinds

_TOKEN = re.compile(TOKEN)


def _longest_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(i, j, n): the longest run of tokens that both have, from a[i] and b[j]; the earliest in a, then in b, counts."""
    found, run = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
    for i, token in enumerate(a):
        run[1:] = np.where(b == token, run[:-1] + 1, 0)
        j = int(run.argmax())
        if run[j] > found[2]:
            found = (i + 1 - int(run[j]), j - int(run[j]), int(run[j]))
    return found


#: Up to this product of their lengths, sequences go through the standard library's matcher, which is faster on short ones.
SHORT = 20_000


def common_runs(a: np.ndarray, b: np.ndarray, short: int = SHORT) -> list[tuple[int, int, int]]:
    """Runs of equal tokens in order: the longest one, then those before it on both sides, and those behind it."""
    if len(a) * len(b) <= short:
        return [tuple(m) for m in SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_matching_blocks() if m.size]
    todo, runs = [(0, len(a), 0, len(b))], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = _longest_run(a[a0:a1], b[b0:b1])
        if n:
            runs.append((a0 + i, b0 + j, n))
            todo += [(a0, a0 + i, b0, b0 + j), (a0 + i + n, a1, b0 + j + n, b1)]
    return sorted(runs)


def _difference(older: str | None, newer: str | None) -> tuple[float, str]:
    sides = [[(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(t or "")] for t in (older, newer)]
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(token, len(number)) for token, _, _ in side], np.int64) for side in sides)
    runs = common_runs(a, b)
    spans, at, to = [], 0, 0
    for i, j, n in [*runs, (len(a), len(b), 0)]:
        if i > at or j > to:
            kind = "delete" if j == to else "insert" if i == at else "replace"
            cut = [(side[x][1], side[y - 1][2]) if x < y else None for side, x, y in ((sides[0], at, i), (sides[1], to, j))]
            spans.append({"operation": kind, "older": cut[0], "newer": cut[1]})
        at, to = i + n, j + n
    total = len(a) + len(b)
    return (2.0 * sum(n for _, _, n in runs) / total if total else 1.0), json.dumps(spans)


def token_differences(pairs: DataFrame, *carried: str) -> DataFrame:
    """(from_id, to_id, ratio, changed_spans) for pairs (from_id, to_id, a, b): similarity of the token sequences of older
    text a and newer text b, twice the tokens in common runs over all tokens (1 without tokens), and the changed spans as
    JSON, offsets in code points of each text. Columns named besides are carried along."""
    rows = pairs.select("from_id", "to_id", *carried, "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, older, newer = batch.columns
            found = [_difference(a, b) for a, b in zip(older.to_pylist(), newer.to_pylist())]
            made = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["from_id", "to_id", *carried, "ratio", "changed_spans"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(run, f"{kept}, ratio double, changed_spans string")


def whole_changes(pairs: DataFrame) -> DataFrame:
    """(from_id, to_id, types, ratio, changed_spans, meaningful, temporal_order, lag_s) for pairs with a, b, older_s, newer_s.

    A pair without changed spans is a NEAR_DUPLICATE. Others have their kinds of change, and FRAMING_SHIFT if the ratio is
    below .65, or else WORDING_DRIFT if it is below .9 or no kind was found. The order is unknown where a time is null.
    Null texts count as empty.
    """
    texts = pairs.withColumns({"a": F.coalesce("a", F.lit("")), "b": F.coalesce("b", F.lit(""))})
    texts = with_change_kinds(texts).withColumns({"kinds": F.array_join("kinds", ","), "lag_s": (F.col("newer_s") - F.col("older_s")).cast("long")})
    rows = token_differences(texts, "kinds", "lag_s").withColumn("meaningful", F.col("changed_spans") != "[]")
    style = F.when(F.col("ratio") < 0.65, "FRAMING_SHIFT").when((F.col("ratio") < 0.9) | (F.col("kinds") == ""), "WORDING_DRIFT")
    types = F.when(~F.col("meaningful"), "NEAR_DUPLICATE").otherwise(F.concat_ws(",", F.when(F.col("kinds") != "", F.col("kinds")), style))
    order = F.when(F.col("lag_s").isNull(), "unknown").when(F.col("lag_s") > 0, "strictly_older").when(F.col("lag_s") == 0, "equal").otherwise("reversed")
    return rows.select("from_id", "to_id", types.alias("types"), "ratio", "changed_spans", "meaningful", order.alias("temporal_order"), "lag_s")
