"""Jaro-Winkler similarity as an Arrow-batched column function.

Spark has no Jaro-Winkler. The score follows the published definition: prefix scale 0.1,
prefix of at most 4 characters, boost only above a Jaro score of 0.7, case-sensitive,
0 for an empty string, NULL for a NULL input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PREFIX_SCALE = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7

# Pairs up to this length are scored together as one character matrix; longer ones singly.
MATRIX_LENGTH = 64


def _matrix(strings: list[str], width: int) -> np.ndarray:
    """Code points, one string per column, padded with 0."""
    padded = "".join(s.ljust(width, "\0") for s in strings)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.ascontiguousarray(codes.reshape(len(strings), width).T)


def _jaro_matrix(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro score of each (left[i], right[i]), all pairs advanced together."""
    n = len(left)
    len_a = np.fromiter(map(len, left), np.int64, n)
    len_b = np.fromiter(map(len, right), np.int64, n)
    wide_a, wide_b = int(len_a.max()), int(len_b.max())
    a, b = _matrix(left, wide_a), _matrix(right, wide_b)
    reach = np.maximum(np.maximum(len_a, len_b) // 2 - 1, 0)
    used = np.zeros((wide_b, n), dtype=bool)
    taken = np.zeros((wide_a, n), dtype=bool)
    widest = int(reach.max())
    for i in range(wide_a):
        open_here = i < len_a
        for j in range(max(0, i - widest), min(wide_b, i + widest + 1)):
            hit = open_here & (a[i] == b[j]) & ~used[j] & (j < len_b) & (abs(i - j) <= reach)
            used[j] |= hit
            taken[i] |= hit
            open_here &= ~hit
    matches = taken.sum(axis=0)
    # The matched characters of both sides, in order, compared position by position.
    order_a = np.cumsum(taken, axis=0)
    order_b = np.cumsum(used, axis=0)
    columns = np.arange(n)
    most = int(matches.max())
    seq_a = np.zeros((most + 1, n), dtype=np.uint32)
    seq_b = np.zeros((most + 1, n), dtype=np.uint32)
    for i in range(wide_a):
        seq_a[np.where(taken[i], order_a[i], 0), columns] = a[i]
    for j in range(wide_b):
        seq_b[np.where(used[j], order_b[j], 0), columns] = b[j]
    swaps = (seq_a[1:] != seq_b[1:]).sum(axis=0) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (matches / len_a + matches / len_b + (matches - swaps) / matches) / 3
    return np.where(matches > 0, score, 0.0)


def _jaro_one(a: str, b: str) -> float:
    """Jaro score of one long pair; each position looks up its character's places in ``b``."""
    places: dict[str, list[int]] = {}
    for j, ch in enumerate(b):
        places.setdefault(ch, []).append(j)
    start = dict.fromkeys(places, 0)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    pairs = []
    for i, ch in enumerate(a):
        spots = places.get(ch)
        if spots is None:
            continue
        # Places are used in rising order and the window only moves right.
        at = start[ch]
        while at < len(spots) and spots[at] < i - reach:
            at += 1
        if at < len(spots) and spots[at] <= i + reach:
            pairs.append((ch, spots[at]))
            at += 1
        start[ch] = at
    m = len(pairs)
    if m == 0:
        return 0.0
    by_b = [ch for ch, _ in sorted(pairs, key=lambda p: p[1])]
    swaps = sum(p[0] != q for p, q in zip(pairs, by_b)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_scores(left: list[str], right: list[str]) -> np.ndarray:
    """Scores of aligned string lists without NULLs."""
    n = len(left)
    jaro = np.zeros(n)
    lengths = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right)), np.int64, n)
    empty = np.fromiter((not x or not y for x, y in zip(left, right)), bool, n)
    for low, high in ((1, 16), (17, MATRIX_LENGTH)):
        rows = np.flatnonzero(~empty & (lengths >= low) & (lengths <= high))
        if len(rows):
            jaro[rows] = _jaro_matrix([left[r] for r in rows], [right[r] for r in rows])
    for r in np.flatnonzero(~empty & (lengths > MATRIX_LENGTH)):
        jaro[r] = _jaro_one(left[r], right[r])
    common = np.zeros(n)
    running = np.ones(n, dtype=bool)
    for p in range(PREFIX_LENGTH):
        running &= np.fromiter((x[p : p + 1] == y[p : p + 1] != "" for x, y in zip(left, right)), bool, n)
        common += running
    return np.where(jaro > BOOST_ABOVE, jaro + PREFIX_SCALE * common * (1 - jaro), jaro)


def _jaro_winkler_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    known = (left.notna() & right.notna()).to_numpy()
    scores = np.full(len(left), np.nan)
    if known.any():
        scores[known] = jaro_winkler_scores(left[known].tolist(), right[known].tolist())
    return pd.Series(scores).where(pd.Series(known), None)


def jaro_winkler(left: Column, right: Column) -> Column:
    """Similarity in [0, 1]."""
    return F.pandas_udf(_jaro_winkler_batch, "double")(left, right)


def jaro_winkler_pinned(left: Column, right: Column) -> Column:
    """The same score, evaluated exactly where it is written in the plan.

    Marked non-deterministic only so that a filter on the score stays above a distinct().
    """
    return F.pandas_udf(_jaro_winkler_batch, "double").asNondeterministic()(left, right)


def register(spark: SparkSession) -> None:
    """Make ``jaro_winkler(a, b)`` callable from SQL."""
    spark.udf.register("jaro_winkler", F.pandas_udf(_jaro_winkler_batch, "double"))
