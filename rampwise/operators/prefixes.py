"""Scores of growing prefixes: a series' values as one array, sent to a kernel with ranges of prefix lengths.

A series of n points has n prefixes, and a prefix of m points has about m ln m blocks. The array of a series is copied to at most ``MOST_RANGES`` ranges of
prefixes, which are dealt out over the cluster; the blocks of a prefix are one vector in the kernel and never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of a range, and the most ranges of a series.
PREFIXES, MOST_RANGES = 24, 512


def running(y: np.ndarray) -> np.ndarray:
    """Rows s, t, c: sums of y and i * y and the number of missing values before each position, from 0 to the end."""
    good = np.isfinite(y)
    y = np.where(good, y, 0.0)
    return np.concatenate([np.zeros((3, 1)), np.cumsum([y, np.arange(len(y)) * y, ~good], axis=1)], axis=1)


def group_medians(x: np.ndarray, group: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The median of each group's values, groups numbered in order and none of them empty."""
    ordered, first = x[np.lexsort((x, group))], np.cumsum(count) - count
    return (ordered[first + (count - 1) // 2] + ordered[first + count // 2]) / 2


def votes(sums: np.ndarray, m: int, low: int, high: int, mad_k: float, direction: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, vote) of the voting blocks of all lengths in a run over the first m points."""
    w = np.arange(low, min(high, m) + 1)
    if m < 3 or not len(w):
        return (np.zeros(0, np.int64),) * 3
    n = m // w
    width = np.repeat(w, n)
    st = np.repeat(m % w // 2, n) + width * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    s, t, c = sums
    good = c[st + width] == c[st]
    st, width = st[good], width[good]
    if not len(st):
        return (np.zeros(0, np.int64),) * 3
    long = width.astype(float)
    slope = ((t[st + width] - t[st]) - (st + (long - 1) / 2) * (s[st + width] - s[st])) / (long * (long * long - 1) / 12)
    _, group, count = np.unique(width, return_inverse=True, return_counts=True)
    off = slope - group_medians(slope, group, count)[group]
    mad = group_medians(np.abs(off), group, count)
    z = off / np.where(mad > 0, mad, 1e-8)[group]
    vote = ((z > mad_k) & (direction != "negative")).astype(np.int64) - ((z < -mad_k) & (direction != "positive"))
    if direction == "negative":
        vote = -vote
    some = vote != 0
    return st[some], width[some], vote[some]


def highest(m: int, low: int, highwl) -> int:
    return max(5, m // 3, low) if isinstance(highwl, str) else max(low, min(int(highwl), m))


def last_score(sums: np.ndarray, m: int, low: int, highwl, mad_k: float, direction: str, smooth: int) -> float:
    """The smoothed score of the last of the first m points: the mean vote over its last ``smooth`` points and all lengths."""
    high, k = highest(m, low, highwl), max(1, min(smooth, m))
    st, w, vote = votes(sums, m, low, high, mad_k, direction)
    return float((vote * np.maximum(0, st + w - np.maximum(m - k, st))).sum() / (k * (high - low + 1)))


def first_scores(sums: np.ndarray, m: int, low: int, highwl, mad_k: float, direction: str, smooth: int) -> np.ndarray:
    """The smoothed scores of all of the first m points, which are seen at once."""
    high = highest(m, low, highwl)
    st, w, vote = votes(sums, m, low, high, mad_k, direction)
    step = np.zeros(m + 1)
    np.add.at(step, st, vote)
    np.add.at(step, st + w, -vote)
    total = np.r_[0.0, np.cumsum(np.cumsum(step[:-1]) / (high - low + 1))]
    at = np.arange(1, m + 1)
    return (total[at] - total[np.maximum(0, at - smooth)]) / np.minimum(at, smooth)


def prefix_scores(series: DataFrame, burn: Column, low: int, highwl, mad_k: float, direction: str, smooth: int) -> DataFrame:
    """(key, i, rt) of the points after the first ``burn`` ones of each series (key, i, n, y); ``burn`` may use n."""
    value = F.coalesce(F.when(F.abs("y") < float("inf"), F.col("y")), F.lit(float("nan")))
    packed = series.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", value.alias("y"))))["y"].alias("y"), F.max("n").alias("n")).withColumn("burn", burn)
    size = F.greatest(F.lit(PREFIXES), F.ceil((F.col("n") - F.col("burn")) / MOST_RANGES)).cast("long")
    ranges = packed.filter("burn < n").withColumn("size", size).select("key", "y", "n", "size", F.explode(F.sequence(F.col("burn") + 1, F.col("n"), F.col("size"))).alias("first"))
    ranges = ranges.withColumn("last", F.least("n", F.col("first") + F.col("size") - 1)).repartition("key", "first")

    @F.pandas_udf("array<double>")
    def scored(y: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for own, a, b in zip(y, first, last, strict=True):
            own = np.asarray(own, float)
            good = np.isfinite(own)
            sums = running(own - (own[good].mean() if good.any() else 0.0))
            out.append([last_score(sums, m, low, highwl, mad_k, direction, smooth) for m in range(int(a), int(b) + 1)])
        return pd.Series(out, dtype=object)

    return ranges.select("key", "first", F.posexplode(scored("y", "first", "last")).alias("at", "rt")).select("key", (F.col("first") - 1 + F.col("at")).alias("i"), "rt")
