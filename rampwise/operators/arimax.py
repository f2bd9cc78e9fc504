"""Regression with ARIMA errors: residuals of one or several series.

A series is differenced, regressed on its regressors (``functions.linear``: Gram matrices by groups, in the JVM; of linearly dependent
regressors the later ones have no effect), and what is left gets an ARMA part (``arma``: Hannan and Rissanen's estimates, errors by blocks of rows). Nothing needs a
whole series in one task but the order of its rows and its lags. Orders that aren't given are searched: the seasonal order of
differencing by the strength of the season and then the order of differencing by the KPSS test, both on the residuals of the regression, p, q and their seasonal counterparts by AIC.

The seasonal part's lag polynomials are factors of the ARMA part's. Columns may have any names, and keys may be NULL. A regressor that doesn't vary has no effect.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.functions.linear import coefficients, fitted
from rampwise.functions.numeric import finite, to_double
from rampwise.operators.arma import LONG, ROWS, arma_errors, blocks
from rampwise.operators.series import key_columns, named, require, resolve, series_key, unclashing
from rampwise.operators.spread import POS, SIZE, numbered, running_sums, with_before
from rampwise.sources.scratch import written

#: The KPSS test's critical value of level stationarity at 5 %.
CRITICAL = 0.463
#: The strength of a season beyond which it is differenced away (Wang, Smith and Hyndman, 2006).
STRONG = 0.64
RESULTS = ("time", "variable", "fitted", "residual", "used")
#: The columns with the orders of a fit.
FITTED = ("p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q")


def prepared(data: DataFrame, time: str, y_cols, xreg_cols=None, keys: list[str] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(key, time, y, x, used): the series and the regressors as arrays of doubles, and whether all of them are finite; with the names of both."""
    require(data, time)
    unclashing(keys, *RESULTS)
    ys, xs = resolve(data, y_cols), resolve(data, xreg_cols) if xreg_cols else []
    kinds = {f.name: f.dataType for f in data.schema}
    values = lambda names: F.array(*(to_double(c, kinds[c]) for c in names)).cast("array<double>")
    own = data.select(series_key(keys), named(time).alias("time"), values(ys).alias("y"), values(xs).alias("x"))
    return own.withColumn("used", F.forall(F.concat("y", "x"), finite)), ys, xs


def regressed(rows: DataFrame, by: str, m: int, k: int, constant: bool, x: str = "x", y: str = "y") -> DataFrame:
    """``rows`` with ``fit``, the fitted values of each value of y on x, and ``beta``, their coefficients."""
    beta = coefficients(rows, by, x, m, y, k, constant)
    return rows.join(beta, by).withColumn("fit", fitted(x, m, k))


def ols_residuals(data: DataFrame, time: str, y: str, x=None, keys: list[str] | None = None) -> DataFrame:
    """(keys, time, fitted, residual, used) of y on a constant and any number of regressors."""
    own, ys, xs = prepared(data, time, y, x, keys)
    if len(ys) != 1:
        raise ValueError("y is one column")
    got = regressed(own.filter("used"), "key", len(xs), 1, constant=True)
    fit, value = F.get("fit", F.lit(0)), F.get("y", F.lit(0))
    return got.select(*key_columns(keys), "time", fit.alias("fitted"), (value - fit).alias("residual"), "used")


def arx_residuals(data: DataFrame, time: str, y: str, x=None, keys: list[str] | None = None, spread: bool = False) -> DataFrame:
    """(keys, time, fitted, residual) of y on a constant, its value one used row before, and any number of regressors. ``spread``: for very long series."""
    own, ys, xs = prepared(data, time, y, x, keys)
    if len(ys) != 1:
        raise ValueError("y is one column")
    if spread:
        own = with_before(numbered(own.filter("used"), "key", ["time"]), "key", POS, [1], ["y"]).withColumn("before", F.get("_before", F.lit(0))["y"])
    else:
        own = own.filter("used").withColumn("before", F.lag("y").over(Window.partitionBy("key").orderBy("time"))).filter("before is not null")
    got = regressed(own.withColumn("x", F.concat("before", "x")), "key", 1 + len(xs), 1, constant=True)
    fit, value = F.get("fit", F.lit(0)), F.get("y", F.lit(0))
    return got.select(*key_columns(keys), "time", fit.alias("fitted"), (value - fit).alias("residual"))


def polynomial(d: int, seasonal_d: int, period: int) -> dict[int, int]:
    """The factors, by lag, of (1 - B)^d (1 - B^period)^D."""
    out = {0: 1}
    for lag in [1] * d + [period] * seasonal_d:
        for k, v in list(out.items()):
            out[k + lag] = out.get(k + lag, 0) - v
    return {k: v for k, v in sorted(out.items()) if v}


def differences(rows: DataFrame, factors: dict[int, int], columns: list[str], spread: bool = False) -> DataFrame:
    """The rows (by, pos, ..) that have enough rows before them, with the arrays in ``columns`` after the differences of ``polynomial``."""
    lags = [k for k in factors if k]
    if not lags:
        return rows
    if spread:
        rows = with_before(rows, "by", "pos", lags, columns)
        earlier = {c: [F.get("_before", F.lit(i))[c] for i in range(len(lags))] for c in columns}
    else:
        over = Window.partitionBy("by").orderBy("pos")
        earlier = {c: [F.lag(c, k).over(over) for k in lags] for c in columns}

    def added(total: Column, before: Column, factor: float) -> Column:
        return F.zip_with(total, before, lambda a, b: a + F.lit(factor) * b)

    def all_added(c: str) -> Column:
        total = F.col(c)
        for k, before in zip(lags, earlier[c], strict=True):
            total = added(total, before, float(factors[k]))
        return total

    got = rows.withColumns({c: all_added(c) for c in columns}).filter(F.col("pos") > max(lags))
    return got.drop("_before")


def with_totals(df: DataFrame, by: str, spread: bool, **totals: Column) -> DataFrame:
    """``df`` with aggregates of each series: from a window, or (``spread``) from an aggregation that is joined, so that no task gets a series."""
    if spread:
        return df.join(df.groupBy(by).agg(*(v.alias(c) for c, v in totals.items())), by)
    return df.select("*", *(v.over(Window.partitionBy(by)).alias(c) for c, v in totals.items()))


def kpss(rows: DataFrame, by: list[str], order_by: str, value: str, spread: bool = False) -> DataFrame:
    """(by, n, statistic): the KPSS statistic of level stationarity of each group's values in their order; NULL for constant groups. Missing values are left out.

    The long-run variance has Newey and West's weights over trunc(4 (n / 100)^(1/4)) lags. ``spread``: for very long groups, no task gets one.
    """
    own = rows.select(F.struct(*map(named, by)).alias("key"), named(order_by).alias("t"), named(value).alias("v")).filter("v is not null")
    own = with_totals(own, "key", spread, n=F.count(F.lit(1)), m=F.avg("v")).withColumn("z", F.col("v") - F.col("m"))
    n = own.agg(F.max("n")).head()[0] or 1
    most = int(4 * (n / 100) ** 0.25)
    lags = F.floor(4 * F.pow(F.col("n") / 100, 0.25))
    if spread:
        own = written(running_sums(numbered(own, "key", ["t"]), "key", {"s": F.col("z")}), "kpss")
        packed = blocks(own.select(F.col("key").alias("by"), F.col(POS).alias("pos"), "n", F.col("z").alias("u")), max(most, 1), max(most, ROWS))
        cross = packed.groupBy(F.col("by").alias("key")).agg(F.sum(F.pandas_udf(neighbours, "double")("u", "lead", lags)).alias("w"))
    else:
        along = Window.partitionBy("key").orderBy("t")
        before = F.collect_list("z").over(along.rowsBetween(-max(most, 1), -1))
        weight = lambda v, i: v * F.greatest(F.lit(0.0), 1 - (F.size("b") - i) / (lags + 1))
        own = own.withColumn("s", F.sum("z").over(along)).withColumn("b", before)
        own = own.withColumn("w", F.col("z") * F.aggregate(F.transform("b", weight), F.lit(0.0), lambda s, v: s + v))
        cross = None
    sums = [F.sum("w").alias("w")] if cross is None else []
    got = own.groupBy("key").agg(F.max("n").alias("n"), F.sum(F.col("z") * F.col("z")).alias("g"), *sums, (F.sum(F.col("s") * F.col("s")) / F.max("n") / F.max("n")).alias("e"), F.max(F.abs("z")).alias("x"), F.max(F.abs("m")).alias("a"))
    got = (got if cross is None else got.join(cross, "key")).withColumn("l", (F.col("g") + 2 * F.col("w")) / F.col("n"))
    varies = (F.col("x") > 1e-12 * F.col("a")) & (F.col("l") > 0)
    return got.select("key.*", "n", F.when(varies, F.col("e") / F.col("l")).alias("statistic"))


def neighbours(u: pd.Series, lead: pd.Series, lags: pd.Series) -> pd.Series:
    """The weighted products of a block's rows with those up to ``lags`` before them."""
    return pd.Series([float(sum((1 - h / (most + 1)) * (x[max(at, h) :] @ x[max(at, h) - h : len(x) - h]) for h in range(1, min(most, len(x) - 1) + 1))) for x, at, most in zip(u, lead, lags, strict=True)], dtype=float)


def differences_needed(rows: DataFrame, most: int, spread: bool = False) -> DataFrame:
    """(by, d): how often each series (by, pos, u) has to be differenced before the KPSS test no longer rejects stationarity."""
    own, out = rows.select("by", "pos", F.array("u").alias("u")), None
    for d in range(most):
        here = kpss(own.select("by", "pos", F.get("u", F.lit(0)).alias("u")), ["by"], "pos", "u", spread).select("by", (F.coalesce("statistic", F.lit(0.0)) > CRITICAL).cast("int").alias(f"r{d}"))
        out = here if out is None else out.join(here, "by", "left")
        # positions count from 1, so that each difference has its first row one position later
        own = differences(own, polynomial(1, 0, 1), ["u"], spread).withColumn("pos", F.col("pos") - 1) if d + 1 < most else own
    d = F.lit(0)
    for k in reversed(range(most)):
        d = F.when(F.coalesce(F.col(f"r{k}"), F.lit(0)) == 1, d + 1).otherwise(0)
    return (out if out is not None else rows.select("by").distinct()).select("by", d.alias("d"))


def seasonal_strength(rows: DataFrame, by: list[str], order_by: str, value: str, period: int, spread: bool = False) -> DataFrame:
    """(by, n, strength): the share of a group's variation about its trend that its season explains, 0 to 1. Missing values are left out.

    The trend is a centred mean of one period (for even periods with half weights at both ends), the season the mean of each phase about it. NULL for groups of less
    than three periods, whose phases have too few values, and for those without variation. ``spread``: for very long groups, no task gets one.
    """
    if period < 2:
        raise ValueError("a season has two rows at least")
    half, along = period // 2, Window.partitionBy("key").orderBy("t")
    own = rows.select(F.struct(*map(named, by)).alias("key"), named(order_by).alias("t"), named(value).alias("v")).filter("v is not null")
    if spread:
        own = numbered(own, "key", ["t"]).select(F.col("key").alias("by"), F.col(POS).alias("pos"), F.col(SIZE).alias("n"), F.col("v").alias("u"))
        packed = blocks(own, 2 * half, max(2 * half, ROWS))
        own = packed.select("by", *(F.expr(f"slice({c}, cast(lead as int) + 1, size({c}))").alias(to) for c, to in (("pos", "i"), ("u", "v"))), about_trend(period)("u", "lead").alias("z"))
        own = own.select(F.col("by").alias("key"), F.explode(F.arrays_zip("i", "v", "z")).alias("r"))
        own = own.select("key", (F.col("r.i") - half).alias("i"), "r.v", F.when(F.col("r.i") > 2 * half, F.col("r.z")).alias("inner"))
    else:
        near = along.rowsBetween(-half, half)
        trend = F.sum("v").over(near) if period % 2 else (F.sum("v").over(near) + F.sum("v").over(along.rowsBetween(1 - half, half - 1))) / 2
        own = own.select("key", F.row_number().over(along).alias("i"), F.count(F.lit(1)).over(near).alias("w"), F.col("v"), (F.col("v") - trend / period).alias("z"))
        own = own.withColumn("inner", F.when(F.col("w") == 2 * half + 1, F.col("z")))
    inner = F.col("inner")
    phases = own.groupBy("key", F.pmod("i", F.lit(period)).alias("phase")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs("v")).alias("a"), F.count(inner).alias("c"), F.avg(inner).alias("m"), F.var_pop(inner).alias("s"), F.max(F.abs(inner)).alias("x"))
    # about a mean of all that is taken first, so that nothing cancels
    means = phases.groupBy("key").agg(F.sum("rows").alias("n"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("m0"), F.sum(F.col("c") * F.col("s")).alias("within"), F.max("x").alias("x"), F.max("a").alias("a"), F.collect_list(F.struct("c", "m")).alias("p"))
    between = F.aggregate(F.transform("p", lambda p: p["c"] * (p["m"] - F.col("m0")) * (p["m"] - F.col("m0"))), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    varies = (F.col("n") >= 3 * period) & (F.col("x") > 1e-12 * F.col("a"))
    return means.select("key", "n", "x", "a", "within", between.alias("between")).select("key.*", "n", F.when(varies & (F.col("within") + F.col("between") > 0), F.col("between") / (F.col("within") + F.col("between"))).alias("strength"))


def about_trend(period: int):
    """A function from a block and its lead to the deviations of rows from their trend: at each own row that of the row half a period before."""
    half = period // 2
    weights = (np.ones(period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5]) / period

    @F.pandas_udf("array<double>")
    def run(u: pd.Series, lead: pd.Series) -> pd.Series:
        out = []
        for x, at in zip(u, lead, strict=True):
            z = np.zeros(len(x))
            if len(x) > 2 * half:
                z[2 * half :] = x[half : len(x) - half] - np.convolve(x, weights, "valid")
            out.append(z[at:])
        return pd.Series(out, dtype=object)

    return run


def arimax_residuals(data: DataFrame, time: str, y_cols, xreg_cols=None, order: tuple[int, int, int] | None = None, keys: list[str] | None = None, seasonal: bool = True, stepwise: bool = True, approximation: bool = False, period: int = 1, seasonal_order: tuple[int, int, int] | None = None, max_p: int = 4, max_q: int = 4, max_d: int = 2, max_seasonal: tuple[int, int] = (1, 1), max_seasonal_d: int = 1, long_ar: int = LONG, given: tuple[list[float], list[float]] | None = None, spread: bool = False) -> DataFrame:
    """(keys, variable, time, fitted, residual, p, d, q, seasonal_p, seasonal_d, seasonal_q, aic, params) over the rows in which every y and regressor is finite.

    ``params``: the constant (without differences) and the regressors' coefficients, those of the AR lags from 1 on with the seasonal factor multiplied in, then those of the MA lags. The first rows that differencing uses up have residual 0. ``period`` and
    ``seasonal_order`` (P, D, Q) are the seasonal part of a given ``order``; where none is given, D may be (as (0, D, 0)), or is 0 or ``max_seasonal_d`` (0 or 1) by the strength of the season, and numbers of seasonal lags up to
    ``max_seasonal`` are searched. ``seasonal=False`` leaves all of it out. All candidates up to ``max_p`` and ``max_q`` are compared, whatever ``stepwise`` and ``approximation`` are. ``long_ar``: the lags of the long autoregression that stands in for the errors; ``given``: AR and MA coefficients that
    aren't to be estimated, each side's own lags first and then those of its seasonal factor. ``spread``: for very long series; positions come from sorted ranges
    and earlier rows by their positions, so that no task gets a series.
    """
    own, ys, xs = prepared(data, time, y_cols, xreg_cols, keys)
    if max_seasonal_d not in (0, 1):
        raise ValueError("max_seasonal_d is 0 or 1")
    if not seasonal or period < 2:
        seasonal_order = (0, 0, 0)
    strengths = order is None and seasonal_order is None and max_seasonal_d == 1
    seasonal_order = seasonal_order or (0, 0, 0)
    if order is None and given:
        raise ValueError("given coefficients need an order")
    if order is None and (seasonal_order[0] or seasonal_order[2]):
        raise ValueError("numbers of seasonal lags are given with an order, or searched up to max_seasonal")
    m = len(xs)
    each = F.explode(F.arrays_zip(F.lit(ys).alias("variable"), F.col("y").alias("y"))).alias("s")
    rows = own.filter("used").select("key", "time", "x", "y")
    if spread:
        rows = numbered(rows, "key", ["time"]).withColumnRenamed(POS, "pos")
    else:
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("time")).cast("long"))
    rows = rows.select("key", "time", "x", "pos", each).select(F.struct("key", "s.variable").alias("by"), "time", "pos", "x", F.array("s.y").alias("y"))
    period, (seasonal_p, seasonal_d, seasonal_q) = max(period, 1), seasonal_order

    def level_residuals(some: DataFrame, seasonal_d: int) -> DataFrame:
        factors = polynomial(0, seasonal_d, period)
        some = differences(some.select("by", "pos", "y", "x"), factors, ["y", "x"], spread)
        return regressed(some, "by", m, 1, constant=True).select("by", (F.col("pos") - max(factors)).alias("pos"), (F.get("y", F.lit(0)) - F.get("fit", F.lit(0))).alias("u"))

    choices = [(order[1] if order else 0, seasonal_d)]
    rows = rows.withColumn("sd", F.lit(seasonal_d))
    if order is None:
        first = written(level_residuals(rows, seasonal_d), "arimax-first")
        if strengths:
            strong = written(seasonal_strength(first, ["by"], "pos", "u", period, spread).select("by", (F.coalesce("strength", F.lit(0.0)) > STRONG).cast("int").alias("sd")), "arimax-seasons")
            rows = rows.drop("sd").join(strong, "by")
            first = first.join(strong.filter("sd = 0").drop("sd"), "by").unionByName(level_residuals(rows.filter("sd = 1"), 1))
            first = written(first, "arimax-first")
        rows = rows.join(written(differences_needed(first, max_d, spread), "arimax-differences"), "by", "left").withColumn("d", F.coalesce("d", F.lit(0)))
        choices = [(d, s) for d in range(max_d + 1) for s in ((0, 1) if strengths else (seasonal_d,))]
    else:
        rows = rows.withColumn("d", F.lit(order[1]))
    parts, free = None, m
    for d, seasonal_d in choices:
        factors = polynomial(d, seasonal_d, period)
        some = rows.filter((F.col("d") == d) & (F.col("sd") == seasonal_d))
        some = differences(some.select("by", "time", "pos", "d", "sd", F.get("y", F.lit(0)).alias("value"), "y", "x"), factors, ["y", "x"], spread)
        constant = d + seasonal_d == 0
        level = F.array(F.get("my", F.lit(0)) - F.aggregate(F.zip_with("mx", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
        got = regressed(some, "by", m, 1, constant).select("by", "time", (F.col("pos") - max(factors)).alias("pos"), "d", "sd", "value", (F.get("y", F.lit(0)) - F.get("fit", F.lit(0))).alias("u"), (F.concat(level, "beta") if constant else F.col("beta")).alias("beta"))
        parts = got if parts is None else parts.union(got)
    u = with_totals(parts, "by", spread, n=F.count(F.lit(1)))
    lags, far = None, ([], [])
    if order is not None:
        lags, far = (list(range(1, order[0] + 1)), list(range(1, order[2] + 1))), tuple([period * k for k in range(1, n + 1)] for n in (seasonal_p, seasonal_q))
    if lags == far == ([], []):
        u = with_totals(u, "by", spread, squares=F.sum(F.col("u") * F.col("u")))
        aic = F.col("n") * F.log(F.greatest(F.col("squares") / F.col("n"), F.lit(1e-300))) + 2 * (free + 1)
        done = u.select("by", "time", "value", F.col("u").alias("e"), F.lit(0).alias("p"), "d", F.lit(0).alias("q"), F.lit(0).alias("seasonal_p"), F.col("sd").alias("seasonal_d"), F.lit(0).alias("seasonal_q"), aic.alias("aic"), F.col("beta").alias("params"))
    else:
        u = written(u, "arimax-rest")
        found = arma_errors(u.select("by", "pos", "n", "u"), lags, free, (max_p, max_q), period, max_seasonal if seasonal and period > 1 else (0, 0), long_ar, given, seasonal_lags=far)
        done = u.select("by", "pos", "time", "d", F.col("sd").alias("seasonal_d"), "value", "beta").join(found, ["by", "pos"]).select("by", "time", "value", "e", *FITTED, "aic", F.concat("beta", "ar", "ma").alias("params"))
    # rows that differencing has used up
    lost = F.col("d") + F.col("sd") * period
    early = rows.filter(F.col("pos") <= lost).select("by", "time", F.get("y", F.lit(0)).alias("value"))
    known = done.groupBy("by").agg(*(F.first(c).alias(c) for c in (*FITTED, "aic", "params")))
    early = early.join(known, "by", "left").select("by", "time", "value", F.lit(0.0).alias("e"), *FITTED, "aic", "params")
    done = done if order is not None and not order[1] + seasonal_order[1] else done.unionByName(early)
    return done.select(*(F.col(f"by.key.k{i}").alias(k) for i, k in enumerate(keys or [])), F.col("by.variable").alias("variable"), "time", (F.col("value") - F.col("e")).alias("fitted"), F.col("e").alias("residual"), *FITTED, "aic", "params")


def arimax_residuals_df(data: DataFrame, time: str, y_cols, xreg_cols=None, order: tuple[int, int, int] | None = None, keys: list[str] | None = None, **options) -> DataFrame:
    """(keys, time, ys): the residuals of every y column in one row for each time."""
    own, ys, xs = prepared(data, time, y_cols, xreg_cols, keys)
    if "time" in ys:
        raise ValueError("a series can't be named time")
    if order == (0, 0, 0) and not any(options.get("seasonal_order") or ()):
        got = regressed(own.filter("used"), "key", len(xs), len(ys), constant=True)
        return got.select(*key_columns(keys), "time", *((F.get("y", F.lit(i)) - F.get("fit", F.lit(i))).alias(c) for i, c in enumerate(ys)))
    got = arimax_residuals(data, time, y_cols, xreg_cols, order, keys, **options)
    wide = got.select(series_key(keys), "time", "variable", "residual").groupBy("key", "time")
    return wide.agg(*(F.max(F.when(F.col("variable") == c, F.col("residual"))).alias(f"r{i}") for i, c in enumerate(ys))).select(*key_columns(keys), "time", *(F.col(f"r{i}").alias(c) for i, c in enumerate(ys)))
