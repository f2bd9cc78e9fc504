"""Regression with ARIMA errors: columns of any name, NULL keys, dependent regressors, long series in blocks, seasonal parts, the order search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampwise.functions.linear import coefficients
from rampwise.operators import arimax, arma, signals

RS = np.random.RandomState(11)


def panel(spark, names, n=40, keys=("a", None)):
    rows = [(k, t, *map(float, RS.normal(size=len(names)))) for k in keys for t in range(n)]
    return spark.createDataFrame(rows, "k string, t long, " + ", ".join(f"`{c.replace('`', '``')}` double" for c in names)).repartition(3)


def least_squares(y, x):
    z = np.column_stack([np.ones(len(y)), x])
    return y - z @ np.linalg.lstsq(z, y, rcond=None)[0]


@pytest.mark.parametrize("names", [("fitted", "lag", "x2"), ("used", "residual", "by"), ("y", "x", "n"), ("a.b", "c`d", "pos"), ("key", "variable", "e"), ("Time2", "beta", "fit")])
def test_columns_of_any_name_and_null_keys(spark, names):
    df = panel(spark, names)
    own = {k: np.array([tuple(r)[2:] for r in df.filter(F.col("k").eqNullSafe(k)).orderBy("t").collect()]) for k in ("a", None)}
    ols = arimax.ols_residuals(df, "t", names[0], list(names[1:]), keys=["k"]).orderBy("time").collect()
    both = arimax.arimax_residuals_df(df, "t", list(names[:2]), [names[2]], (0, 0, 0), keys=["k"]).orderBy("time").collect()
    arx = arimax.arx_residuals(df, "t", names[0], list(names[1:]), keys=["k"]).orderBy("time").collect()
    ma = arimax.arimax_residuals_df(df, "t", list(names[:2]), [names[2]], (0, 0, 1), keys=["k"])
    assert ma.columns == ["k", "time", *names[:2]] and ma.count() == 80
    for k, z in own.items():
        assert np.allclose([r["residual"] for r in ols if r["k"] == k], least_squares(z[:, 0], z[:, 1:]), atol=1e-9)
        for i in range(2):
            assert np.allclose([r[names[i]] for r in both if r["k"] == k], least_squares(z[:, i], z[:, 2]), atol=1e-9)
        assert np.allclose([r["residual"] for r in arx if r["k"] == k], least_squares(z[1:, 0], np.column_stack([z[:-1, 0], z[1:, 1:]])), atol=1e-9)
    raw = signals.build_signal_raw(df, "t", names[0], keys=["k"])
    assert raw.columns == ["k", "time_ind", "signal"] and abs(raw.agg(F.sum("signal")).head()[0] - sum(z[:, 0].sum() for z in own.values())) < 1e-9
    assert signals.build_signal_arimax_svd(df, "t", list(names[:2]), [names[2]], 5, keys=["k"], order=(0, 0, 0)).count() == 72


def test_regressors_without_variation_and_dependent_ones(spark):
    rows = [(k, t, float(y), 2.0 if k == "flat" else float(x), 7.0, float(3.0 * x + 1)) for k in ("flat", "full") for t, (y, x) in enumerate(RS.normal(size=(30, 2)))]
    df = spark.createDataFrame(rows, "k string, t int, y double, x double, c double, twice double")
    for r in arimax.ols_residuals(df, "t", "y", ["x", "c"], keys=["k"]).filter("k = 'flat'").collect():
        assert abs(r["fitted"] - np.mean([v[2] for v in rows[:30]])) < 1e-9
    got = arimax.ols_residuals(df, "t", "y", "x|c|twice", keys=["k"]).filter("k = 'full'").orderBy("time").collect()
    z = np.array([v[2:4] for v in rows[30:]])
    assert np.allclose([r["residual"] for r in got], least_squares(z[:, 0], z[:, 1]), atol=1e-9)
    assert arimax.arx_residuals(df, "t", "y", "c", keys=["k"]).count() == 58
    exact = df.withColumn("s", 2 * F.col("x") - F.col("y") + 5)
    assert arimax.ols_residuals(exact, "t", "s", ["x", "y"], keys=["k"]).agg(F.max(F.abs("residual"))).head()[0] < 1e-9


def test_rows_with_missing_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("inf"), 1.0), (4, 2.0, float("nan")), (5, 3.0, 4.0)], "t int, y double, x double")
    assert [r["time"] for r in arimax.ols_residuals(df, "t", "y", "x").orderBy("time").collect()] == [1, 5]
    for order in ((0, 0, 0), (1, 1, 1), None):
        assert arimax.arimax_residuals(df.filter("t > 9"), "t", "y", "x", order).count() == 0
        assert arimax.arimax_residuals(df, "t", "y", "x", order).count() == 2


def recursion(u, ar, ma):
    e = np.zeros(len(u))
    for t in range(len(u)):
        e[t] = u[t] - sum(a * u[t - i] for i, a in enumerate(ar, 1) if t >= i) - sum(m * e[t - j] for j, m in enumerate(ma, 1) if t >= j)
    return e


@pytest.mark.parametrize("ar,ma", [([0.5], []), ([], [-0.8]), ([0.4, -0.2], [0.9, 0.3]), ([0.0] * 6 + [0.5], [0.3, 0.0, 0.0, -0.4])])
def test_errors_of_long_series_are_put_together_from_blocks(spark, ar, ma):
    series = {1: RS.normal(size=700), 2: RS.normal(size=23), 3: RS.normal(size=5), 4: RS.normal(size=200)}
    rows = spark.createDataFrame([(k, t + 1, len(u), float(v)) for k, u in series.items() for t, v in enumerate(u)], "k long, pos long, n long, u double").select(F.struct("k").alias("by"), "pos", "n", "u")
    lags = tuple(list(range(1, len(c) + 1)) for c in (ar, ma))
    got = arma.arma_errors(rows, lags, given=(ar, ma), long=3, size=16).select("by.k", "pos", "e").orderBy("pos").collect()
    for k, u in series.items():
        assert np.allclose([r["e"] for r in got if r["k"] == k], recursion(u, ar, ma), atol=1e-9)


def test_estimates_don_t_depend_on_the_blocks(spark):
    u = np.zeros(900)
    e = RS.normal(size=900)
    for t in range(2, 900):
        u[t] = 0.6 * u[t - 1] - 0.2 * u[t - 2] + e[t] + 0.5 * e[t - 1]
    rows = spark.createDataFrame([(1, t + 1, 900, float(v)) for t, v in enumerate(u)], "k long, pos long, n long, u double").select(F.struct("k").alias("by"), "pos", "n", "u")
    found = [arma.arma_errors(rows, ([1, 2], [1]), size=size).orderBy("pos").collect() for size in (40, 5000)]
    assert np.allclose([r["e"] for r in found[0]], [r["e"] for r in found[1]], atol=1e-8)
    assert np.allclose(found[0][0]["ar"], [0.6, -0.2], atol=0.15) and np.allclose(found[0][0]["ma"], [0.5], atol=0.15)
    assert np.std([r["e"] for r in found[0]]) < 1.1


def test_seasonal_lags_and_differences(spark):
    e, y = RS.normal(size=600), np.zeros(600)
    for t in range(600):
        y[t] = e[t] + 0.7 * (y[t - 12] if t >= 12 else 0)
    level = 3 * np.sin(np.arange(600) * np.pi / 6) * 10 + y
    df = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(zip(y, level, strict=True))], "t int, y double, s double")
    got = arimax.arimax_residuals(df, "t", "y", None, (0, 0, 0), period=12, seasonal_order=(1, 0, 0)).orderBy("time").collect()
    assert len(got[0]["params"]) == 13 and abs(got[0]["params"][-1] - 0.7) < 0.1
    assert np.std([r["residual"] for r in got]) < 1.1
    off = arimax.arimax_residuals(df, "t", "s", None, (1, 1, 0), period=12, seasonal_order=(0, 1, 1)).orderBy("time").collect()
    assert len(off) == 600 and all(r["residual"] == 0 for r in off[:13]) and np.std([r["residual"] for r in off[13:]]) < 2
    assert arimax.polynomial(1, 1, 12) == {0: 1, 1: -1, 12: -1, 13: 1}
    with pytest.raises(ValueError):
        arimax.arimax_residuals(df, "t", "y", None, period=12, seasonal_order=(1, 0, 0))
    found = arimax.arimax_residuals(df, "t", "y", None, period=12, max_d=0).orderBy("time").collect()
    ar = found[0]["params"][1:13]  # after the constant
    assert found[0]["d"] == 0 and abs(ar[11] - 0.7) < 0.15 and np.std([r["residual"] for r in found]) < 1.1
    plain = arimax.arimax_residuals(df, "t", "y", None, period=12, seasonal=False, max_d=0).head()
    assert len(plain["params"]) == 9 and plain["aic"] > found[0]["aic"] + 100
    off = arimax.arimax_residuals(df, "t", "s", None, period=12, seasonal_order=(0, 1, 0), max_d=0).orderBy("time").collect()
    assert off[0]["d"] == 0 and all(r["residual"] == 0 for r in off[:12]) and np.std([r["residual"] for r in off[12:]]) < 1.3


def products(own, far, period, sign):
    """The coefficients, from lag 1 on, of a product of lag polynomials."""
    one, two = np.r_[1.0, sign * np.array(own)], np.zeros(period * len(far) + 1)
    two[0] = 1.0
    two[period::period] = sign * np.array(far)
    return (sign * np.convolve(one, two))[1:]


@pytest.mark.parametrize("given", [([0.3, 0.4], [-0.5, 0.2]), ([0.3, 0.2, 0.4], [0.6]), ([0.5], [0.3, -0.2, 0.4, 0.1])])
def test_seasonal_parts_are_factors(spark, given):
    p, q, far_p, far_q = {(2, 2): (1, 1, 1, 1), (3, 1): (2, 0, 1, 1), (1, 4): (0, 2, 1, 2)}[len(given[0]), len(given[1])]
    u = RS.normal(size=150)
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(u)], "t int, y double")
    got = arimax.arimax_residuals(df, "t", "y", None, (p, 0, q), period=5, seasonal_order=(far_p, 0, far_q), given=given).orderBy("time").collect()
    ar, ma = products(given[0][:p], given[0][p:], 5, -1), products(given[1][:q], given[1][q:], 5, 1)
    assert np.allclose([r["residual"] for r in got], recursion(u - u.mean(), ar, ma), atol=1e-9)
    assert np.allclose(got[0]["params"][1:], np.r_[ar, ma]) and [got[0][c] for c in arimax.FITTED] == [p, 0, q, far_p, 0, far_q]


def test_products_have_the_least_sum_of_squares():
    x = RS.normal(size=(400, 6))
    x[:, -1] += x[:, :-1] @ [0.5, -0.3, 0.2, 0.4, 0.1]
    order = arma.Order([1], [1], [4], [4])
    lags = (order.lags(0), order.lags(1))
    assert lags == ([1, 4, 5], [1, 4, 5])
    x = np.column_stack([x[:, :3], RS.normal(size=400), x[:, 3:]])
    beta, sse = order.fitted(x.T @ x, lags)
    assert abs(sse - ((x[:, -1] - x[:, :-1] @ beta) ** 2).sum()) < 1e-6 and abs(beta[2] + beta[0] * beta[1]) < 1e-12 and abs(beta[5] - beta[3] * beta[4]) < 1e-12
    base = np.array([beta[0], beta[1], beta[3], beta[4]])
    for step in RS.normal(size=(200, 4)) * np.repeat([0.3, 0.01], 100)[:, None]:
        a, b, c, d = base + step
        assert ((x[:, -1] - x[:, :-1] @ [a, b, -a * b, c, d, c * d]) ** 2).sum() >= sse - 1e-9


def test_seasonal_models_are_found_again(spark):
    e, u = RS.normal(size=1500), np.zeros(1500)
    ar, ma = products([0.5], [0.6], 12, -1), products([], [0.4], 12, 1)
    for t in range(1500):
        u[t] = e[t] + sum(a * u[t - k] for k, a in enumerate(ar, 1) if k <= t) + sum(b * e[t - k] for k, b in enumerate(ma, 1) if k <= t)
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(u)], "t int, y double")
    got = arimax.arimax_residuals(df, "t", "y", None, (1, 0, 0), period=12, seasonal_order=(1, 0, 1)).orderBy("time").collect()
    params = np.array(got[0]["params"][1:])
    assert np.allclose(params[[0, 11, 12, 24]], [0.5, 0.6, -0.3, 0.4], atol=0.1) and abs(params[12] + params[0] * params[11]) < 1e-9
    assert np.std([r["residual"] for r in got]) < 1.1
    found = arimax.arimax_residuals(df, "t", "y", None, period=12, max_p=2, max_q=1, max_d=0).head()
    assert found["seasonal_p"] == 1 and found["seasonal_d"] == 0 and found["p"] >= 1


def strength(y, m):
    """Decomposition by a centred mean and means of phases, step by step."""
    weights = np.ones(m) if m % 2 else np.r_[0.5, np.ones(m - 1), 0.5]
    half = m // 2
    z = y[half : len(y) - half] - np.convolve(y, weights / m, "valid")
    phase = np.arange(half, len(y) - half) % m
    season = np.array([z[phase == k].mean() for k in range(m)])[phase]
    return 1 - (z - season).var() / (z - z.mean()).var()


def test_the_strength_of_a_season_and_its_search(spark):
    t = np.arange(240)
    series = {"wave": 5 * np.sin(t * np.pi / 6) + 0.05 * t + RS.normal(size=240), "noise": RS.normal(size=240), "short": RS.normal(size=30), "flat": np.full(60, 3.0), None: np.tile([1.0, 5.0, 2.0], 80) + RS.normal(size=240) * 0.1}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, t int, y double").repartition(3)
    for m in (3, 4, 12):
        got = {r["k"]: r for r in arimax.seasonal_strength(df, ["k"], "t", "y", m).collect()}
        assert {k: r["n"] for k, r in got.items()} == {k: len(x) for k, x in series.items()} and got["flat"]["strength"] is None
        for k in ("wave", "noise", None):
            assert abs(got[k]["strength"] - strength(series[k], m)) < 1e-9
    assert got["short"]["strength"] is None
    assert arimax.seasonal_strength(df.filter("t < 0"), ["k"], "t", "y", 4).count() == 0
    options = dict(keys=["k"], period=12, max_p=1, max_q=1, max_d=1, max_seasonal=(1, 1))
    fits = arimax.arimax_residuals(df, "t", "y", None, **options).collect()
    first = {r["k"]: r for r in fits}
    assert len(fits) == sum(map(len, series.values())) and {k: r["seasonal_d"] for k, r in first.items()} == {"wave": 1, "noise": 0, "short": 0, "flat": 0, None: 1}
    assert all(r["residual"] == 0 for r in fits if r["k"] == "wave" and r["time"] < 12)
    kept = arimax.arimax_residuals(df, "t", "y", None, max_seasonal_d=0, **options).filter("k = 'wave'").head()
    assert kept["seasonal_d"] == 0
    with pytest.raises(ValueError):
        arimax.seasonal_strength(df, ["k"], "t", "y", 1)


def test_kpss_and_the_search(spark):
    walk, noise = np.cumsum(RS.normal(size=400)), RS.normal(size=400)
    rows = [(k, t, float(v)) for k, x in (("walk", walk), ("noise", noise), ("twice", np.cumsum(np.cumsum(RS.normal(size=400)))), ("flat", np.full(400, 5.0))) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    stat = {r["k"]: r["statistic"] for r in arimax.kpss(df, ["k"], "t", "y").collect()}
    z = noise - noise.mean()
    lrv = (z @ z + 2 * sum((1 - h / 6) * (z[h:] @ z[:-h]) for h in range(1, 6))) / 400
    assert abs(stat["noise"] - (np.cumsum(z) ** 2).sum() / 400**2 / lrv) < 1e-9 and stat["flat"] is None
    got = {r["k"]: r for r in arimax.arimax_residuals(df, "t", "y", None, keys=["k"]).dropDuplicates(["k"]).collect()}
    assert {k: r["d"] for k, r in got.items()} == {"walk": 1, "noise": 0, "twice": 2, "flat": 0}
    assert len(got) == 4 and got["noise"]["p"] + got["noise"]["q"] <= 2


def test_fit_options_reach_every_operator(spark):
    df = panel(spark, ("y", "z", "x"), n=60, keys=("a",))
    same = {"seasonal_order": (0, 1, 0), "period": 5}
    resid = arimax.arimax_residuals_df(df, "t", ["y", "z"], "x", (0, 0, 0), **same)
    a = signals.build_signal_arimax_svd(df, "t", ["y", "z"], "x", 8, order=(0, 0, 0), fit_options=same).orderBy("time_ind").collect()
    y = np.array([(r["y"], r["z"]) for r in resid.orderBy("time").collect()])
    assert (y[:5] == 0).all() and len(a) == 53
    w = (y[20:28] - y[20:28].mean(axis=0)) / y[20:28].std(axis=0, ddof=1)
    assert abs(a[20]["signal"] - np.linalg.eigvalsh(np.cov(w.T))[-1]) < 1e-9
    assert signals.build_signal_arimax_resid(df, "t", "y", "x", order=(0, 0, 0), **same).count() == 60


def test_a_constant_put_together_from_parts_has_no_effect(spark):
    """3.5 / 25 * 25 isn't 3.5 in doubles, so that the parts' means differ in the last bit."""
    rs = np.random.RandomState(5)
    rows = [(t % 2, 3.5, *map(float, rs.normal(size=2))) for t in range(200)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "k long, same double, x double, y double").filter("k = 0")
    got = coefficients(df.select(F.col("k").alias("by"), F.array("same", "x").alias("x"), F.array("y").alias("y")), "by", "x", 2, "y", 1, True).head()
    x, y = (np.array([r[i] for r in rows if not r[0]]) for i in (2, 3))
    assert got["beta"][0] == 0 and np.isclose(got["beta"][1], np.cov(x, y)[0, 1] / np.var(x, ddof=1))
