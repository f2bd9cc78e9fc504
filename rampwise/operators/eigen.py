"""Rolling covariance matrices and their eigenvalues, loadings and scores.

Up to three columns, all covariances of a window are window aggregates over one frame (one exchange, one sort) and eigenvalues are
closed forms in SQL. More columns go through the running sums of ``moments``, by blocks of rows; so do windows of more than ``FRAME_ROWS`` rows,
since a sliding frame is added up anew for each row and running sums cost the same for any window. Eigenvectors are made unique by a
sign rule: the entry of largest size is positive (the first of equals).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.functions.numeric import to_double
from rampwise.operators.moments import Block, spectra
from rampwise.operators.series import POLICIES, key_columns, named, positioned, present, require, resolve, series_key, unclashing
from rampwise.operators.windows import bounded, checked, ends, frame, window_number


#: The rows of the largest sliding frame that is left to window aggregates.
FRAME_ROWS = 256


def covariances(series: DataFrame, cols: list[str], over, na_action: str = "omit_rows", cov_on_pairwise: bool = True) -> tuple[dict, dict, Column]:
    """Covariance of each pair i <= j, scale of each column, and the number of rows, as window columns; NULL where the window is skipped."""
    x = {c: F.col(c) for c in cols}
    whole = F.lit(True)
    for c in cols:
        whole = whole & x[c].isNotNull()
    masked = {c: F.when(whole, x[c]) for c in cols}
    rows = F.count(F.lit(1)).over(over)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    spread = lambda v: F.coalesce(F.stddev_samp(v).over(over), F.lit(0.0))
    if na_action == "impute_mean":
        n = {c: F.count(x[c]).over(over) for c in cols}
        mean = {c: F.avg(x[c]).over(over) for c in cols}
        usable = rows >= 2
        for c in cols:
            usable = usable & (n[c] > 1)
        cov = {}
        for a, b in pairs:
            both = x[a].isNotNull() & x[b].isNotNull()
            total = lambda v: F.coalesce(F.sum(F.when(both, v)).over(over), F.lit(0.0))  # noqa: B023, E731
            cov[a, b] = F.when(usable, (total(x[a] * x[b]) - mean[b] * total(x[a]) - mean[a] * total(x[b]) + F.count(F.when(both, F.lit(1))).over(over) * mean[a] * mean[b]) / (rows - 1))
        return cov, {c: F.sqrt(F.greatest(cov[c, c], F.lit(0.0))) for c in cols}, rows
    pairwise = na_action == "pairwise_complete"
    used = x if pairwise and cov_on_pairwise else masked
    n = rows if pairwise else F.count(F.when(whole, F.lit(1))).over(over)
    cov = {(a, b): F.when(n >= 2, F.covar_samp(used[a], used[b]).over(over)) for a, b in pairs}
    return cov, {c: spread(x[c] if pairwise else masked[c]) for c in cols}, n


def _closed(p: int, s) -> Column:
    if p == 1:
        return F.array(s(0, 0))
    if p == 2:
        half, root = (s(0, 0) + s(1, 1)) / 2, F.sqrt(F.pow((s(0, 0) - s(1, 1)) / 2, 2) + s(0, 1) * s(0, 1))
        return F.array(half + root, half - root)
    q = (s(0, 0) + s(1, 1) + s(2, 2)) / 3
    a, b, c, d, e, f = s(0, 0) - q, s(1, 1) - q, s(2, 2) - q, s(0, 1), s(0, 2), s(1, 2)
    size = F.sqrt((a * a + b * b + c * c + 2 * (d * d + e * e + f * f)) / 6)
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * size * size * size)))) / 3
    first, last = q + 2 * size * F.cos(angle), q + 2 * size * F.cos(angle + F.lit(2 * math.pi / 3))
    return F.when(size > 0, F.array(first, 3 * q - first - last, last)).otherwise(F.array(q, q, q))


def _stack(packed: pd.Series, p: int) -> np.ndarray:
    flat = np.array(packed.tolist(), float).reshape(len(packed), -1)
    out = np.zeros((len(packed), p, p))
    i, j = np.triu_indices(p)
    out[:, i, j] = out[:, j, i] = flat
    return out


def eigenpairs(p: int):
    """An Arrow function from upper triangles to eigenvalues and eigenvectors (one array for each factor)."""

    @F.pandas_udf("d array<double>, v array<array<double>>")
    def pairs(packed: pd.Series) -> pd.DataFrame:
        d, v = [None] * len(packed), [None] * len(packed)
        some = np.flatnonzero(packed.notna().to_numpy())
        if len(some):
            value, vector = np.linalg.eigh(_stack(packed.iloc[some], p))
            value, vector = value[:, ::-1], np.swapaxes(vector[:, :, ::-1], 1, 2)
            lead = np.take_along_axis(vector, np.argmax(np.round(np.abs(vector), 12), axis=2)[:, :, None], axis=2)
            vector = np.where(lead < 0, -vector, vector)
            for k, i in enumerate(some):
                d[i], v[i] = value[k].tolist(), vector[k].tolist()
        return pd.DataFrame({"d": d, "v": v})

    return pairs


def prepared(data: DataFrame, time: str, x_cols, keys: list[str] | None, order_by: list[str] | None = None) -> DataFrame:
    """(key, time, o0.., x0..): the series' key, time, order and features under names of this module, so that the caller's names can't clash with them."""
    names, kinds = resolve(data, x_cols), {f.name: f.dataType for f in data.schema}
    order = [named(c).alias(f"o{i}") for i, c in enumerate(order_by or [time])]
    return data.select(series_key(keys), named(time).alias("time"), *order, *(to_double(c, kinds[c]).alias(f"x{i}") for i, c in enumerate(names)))


def roll_svd(data: DataFrame, time: str, x_cols, window: int, step: int = 1, align: str = "end", type: str = "rolling", center: bool = True, scale_: bool = False, k: int | None = None, fast: bool = True, na_action: str = "omit_rows", cov_on_pairwise: bool = True, values_only: bool = True, seed: int | None = None, keys: list[str] | None = None, order_by: list[str] | None = None, spread: bool = False) -> DataFrame:
    """(keys, window_id, start, end, t_rep, n_w, d[, v]): eigenvalues of each window's covariance, largest first; NULL where it is skipped.

    ``spread`` is for very long series: positions by ranges, windows by blocks of rows, whatever the number of columns, so that no task gets a whole series.
    ``center``, ``fast`` and ``seed`` don't change the result. ``scale_`` divides by the columns' standard deviations (1 where it is 0).
    """
    align, type = checked(window, step, align, type)
    if na_action not in POLICIES:
        raise ValueError(f"na_action is one of {POLICIES}")
    require(data, time)
    unclashing(keys, "window_id", "start", "end", "t_rep", "n_w", "d", "v")
    x = prepared(data, time, x_cols, keys, order_by)
    cols = [c for c in x.columns if c.startswith("x")]
    series = positioned(x, [c for c in x.columns if c.startswith("o")], ["key"], spread)
    p, over = len(cols), frame(window, type, ["key"])
    if p > 3 or spread or (type == "rolling" and window > FRAME_ROWS):
        own = spectra(series, cols, Block(p, window, step, type == "expanding", na_action, cov_on_pairwise, scale_, k, not values_only, fast))
        own = bounded(own.withColumn("window_id", window_number(window, step)), window, type, "pos")
        return timed(own, series, keys, align, values_only)
    cov, scale, n = covariances(series, cols, over, na_action, cov_on_pairwise)
    own = series.select("key", F.col("time").alias("t_end"), "pos", "n", n.alias("n_w"), *(v.alias(f"s_{cols.index(a)}_{cols.index(b)}") for (a, b), v in cov.items()), *((v.alias(f"sd_{cols.index(c)}") for c, v in scale.items()) if scale_ else ()), *((F.avg(c).over(over).alias(f"m_{i}") for i, c in enumerate(cols)) if scale_ else ()))
    own = bounded(ends(own, window, step), window, type, "pos")

    def sd(i: int) -> Column:  # rounding noise of a constant column counts as 0
        return F.when(F.col(f"sd_{i}") > 1e-12 * F.abs(F.coalesce(F.col(f"m_{i}"), F.lit(0.0))), F.col(f"sd_{i}")).otherwise(F.lit(1.0))

    def s(i: int, j: int) -> Column:
        v = F.col(f"s_{min(i, j)}_{max(i, j)}")
        return v / (sd(i) * sd(j)) if scale_ else v

    triangle = [s(i, j) for i in range(p) for j in range(i, p)]
    whole = F.lit(True)
    for i in range(p):
        for j in range(i, p):
            c = F.col(f"s_{i}_{j}")
            whole = whole & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    packed = F.when(whole, F.array(*triangle))
    size = F.least(F.lit(p if k is None else k), F.col("n_w").cast("int"), F.lit(p))
    if values_only:
        d = F.when(whole, _closed(p, s))
        own = own.withColumn("d", F.slice(d, 1, F.greatest(F.lit(1), size)))
    else:
        own = own.withColumn("_e", eigenpairs(p)(packed))
        own = own.withColumn("d", F.slice("_e.d", 1, F.greatest(F.lit(1), size))).withColumn("v", F.slice("_e.v", 1, F.greatest(F.lit(1), size)))
    return timed(own, series, keys, align, values_only)


def timed(own: DataFrame, series: DataFrame, keys: list[str] | None, align: str, values_only: bool) -> DataFrame:
    """The result's columns, with the time of each window's representative row."""
    tail = ["n_w", "d"] + ([] if values_only else ["v"])
    if align == "end" and "t_end" in own.columns:
        return own.select(*key_columns(keys), "window_id", "start", F.col("pos").alias("end"), F.col("t_end").alias("t_rep"), *tail)
    at = {"start": F.col("start"), "end": F.col("pos"), "center": F.floor((F.col("start") + F.col("pos")) / 2).cast("long")}[align]
    own = own.select("key", "window_id", "start", F.col("pos").alias("end"), at.alias("at"), *tail)
    times = series.select("key", F.col("pos").alias("at"), F.col("time").alias("t_rep"))
    return own.join(times, ["key", "at"]).select(*key_columns(keys), "window_id", "start", "end", "t_rep", *tail)


def tidy_values(result: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, window_id, factor, d) of all windows that weren't skipped."""
    unclashing(keys, "window_id", "factor", "d")
    own = result.select(series_key(keys), "window_id", F.posexplode("d").alias("at", "d"))
    return own.select(*key_columns(keys), "window_id", (F.col("at") + 1).cast("long").alias("factor"), "d")


def tidy_loadings(result: DataFrame, variables: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, window_id, variable, factor, loading)."""
    if "v" not in result.columns:
        raise ValueError("loadings need values_only=False")
    names = F.array(*map(F.lit, variables))
    unclashing(keys, "window_id", "variable", "factor", "loading")
    own = result.select(series_key(keys), "window_id", F.posexplode("v").alias("at", "own")).select("key", "window_id", "at", F.posexplode("own").alias("i", "loading"))
    return own.select(*key_columns(keys), "window_id", F.get(names, F.col("i")).alias("variable"), (F.col("at") + 1).cast("long").alias("factor"), "loading")


def as_tibble_rollsvd(result: DataFrame, what: str = "singular_values", variables: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """``tidy_values`` or ``tidy_loadings``; an empty table where no window has a result."""
    if what == "singular_values":
        return tidy_values(result, keys)
    if what == "loadings":
        return tidy_loadings(result, variables or [], keys)
    raise ValueError("what is singular_values or loadings")


def scores(data: DataFrame, result: DataFrame, time: str, x_cols, center: bool = True, scale_: bool = False, keys: list[str] | None = None) -> DataFrame:
    """(keys, window_id, row_pos, factor, score): centred (and scaled) complete rows of each window times its loadings."""
    unclashing(keys, "window_id", "row_pos", "factor", "score")
    x = prepared(data, time, x_cols, keys)
    cols = [c for c in x.columns if c.startswith("x")]
    series = positioned(x, ["o0"], ["key"]).filter(present(cols)).select("key", "pos", F.array(*cols).alias("x"))
    member = result.filter("v is not null").select(series_key(keys), "window_id", "v", F.explode(F.sequence("start", "end")).alias("pos"))
    own = member.join(series, ["key", "pos"])
    group = ["key", "window_id"]
    stats = own.groupBy(*group).agg(*(F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(cols))), *(F.stddev_samp(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(len(cols))))
    own = own.join(stats, group)
    shifted = [(F.get("x", F.lit(i)) - (F.col(f"m{i}") if center else F.lit(0.0))) / (F.when(F.col(f"s{i}") > 1e-12 * F.abs(F.col(f"m{i}")), F.col(f"s{i}")).otherwise(F.lit(1.0)) if scale_ else F.lit(1.0)) for i in range(len(cols))]
    own = own.select(*group, "pos", F.array(*shifted).alias("z"), F.posexplode("v").alias("k", "own"))
    return own.select(*key_columns(keys), "window_id", F.col("pos").alias("row_pos"), (F.col("k") + 1).cast("long").alias("factor"), F.aggregate(F.zip_with("z", "own", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))
