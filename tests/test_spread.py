"""Very long series in ranges of rows: positions, running sums, medians and votes, equal to the forms with one partition a series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampwise.functions.numeric import robust_z as plain_z
from rampwise.operators import arimax, detect, eigen, series, spread
from rampwise.operators.spread import with_before

RS = np.random.RandomState(9)


def table(spark, sizes, values=None):
    rows = [(k, int(t), float(v)) for k, n in sizes.items() for t, v in zip(RS.permutation(n), RS.normal(size=n) if values is None else values[:n], strict=True)]
    return spark.createDataFrame(rows, "k string, t long, v double").repartition(5)


def test_positions_of_keys_nulls_and_one_series(spark):
    df = table(spark, {"a": 900, None: 40, "b": 1})
    for keys in (["k"], None):
        want = series.positioned(df, ["t", "v"], keys).select("k", "t", "v", "pos", "n").collect()
        got = series.positioned(df, ["t", "v"], keys, spread=True)
        assert got.columns == [*df.columns, "pos", "n"]
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert series.positioned(df.filter("t < 0"), ["t"], spread=True).count() == 0
    assert series.positioned(df.selectExpr("k as `_row`", "t as `a.b`", "v as `_size`"), ["a.b"], spread=True).columns == ["_row", "a.b", "_size", "pos", "n"]


def test_ranges_are_many_and_no_task_gets_a_series(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    own = spread.numbered(table(spark, {"a": 20_000}, np.zeros(20_000)), "k", ["v"])
    sizes = [r["count"] for r in own.groupBy(spread.PART).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 12_000
    assert own.agg(F.count_distinct(spread.POS), F.max(spread.POS)).head() == (20_000, 20_000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums(spark):
    own = spread.numbered(table(spark, {"a": 700, "b": 30}), "k", ["t"])
    got = spread.running_sums(own, "k", {"s": F.col("v"), "c": F.lit(1)}).orderBy("k", "t").collect()
    for k, n in (("a", 700), ("b", 30)):
        rows = [r for r in got if r.k == k]
        assert np.allclose([r.s for r in rows], np.cumsum([r.v for r in rows]), atol=1e-9) and [r.c for r in rows] == list(range(1, n + 1))


def test_medians_of_groups_of_any_size(spark):
    df = table(spark, {"a": 30_001, "b": 2, "c": 1, "even": 5000}).union(spark.createDataFrame([("none", 0, None), ("b", 9, None)], "k string, t long, v double"))
    got = {r.k: r["median"] for r in spread.medians(df, "k", "v").collect()}
    assert got == {r.k: r.m for r in df.filter("v is not null").groupBy("k").agg(F.median("v").alias("m")).collect()}
    z = {(r.k, r.t): r.z for r in spread.robust_z(df, "k", "v").collect()}
    want = {(r.k, r.t): r.z for r in plain_z(df, "v", ["k"]).collect()}
    assert z.keys() == want.keys() and all((z[p] is None) == (want[p] is None) and (z[p] is None or abs(z[p] - want[p]) < 1e-9) for p in z)
    ties = table(spark, {"x": 4000}, np.repeat([1.0, 2.0], 2000))
    assert spread.medians(ties, "k", "v").head()["median"] == 1.5


def test_robust_z_keeps_the_caller_s_columns(spark):
    df = spark.createDataFrame([(1, 1.0, "p"), (1, 2.0, "q"), (1, 4.0, "r")], "_off int, _mad double, z0 string")
    assert plain_z(df, "_mad", ["_off"]).columns == ["_off", "_mad", "z0", "z"]
    assert [r.z for r in plain_z(df, "_mad", ["_off"]).orderBy("_mad").collect()] == [-1.0, 0.0, 2.0]


def test_votes_and_eigenvalues(spark):
    y = RS.normal(size=300)
    y[100:112] += np.arange(12) * 3
    rows = [(k, t, None if t == 50 else float(v), float(v * v)) for k in ("a", None) for t, v in enumerate(y[: 300 if k else 2])]
    df = spark.createDataFrame(rows, "k string, t long, signal double, other double")
    for keys in (["k"], None):
        order = ["t"] if keys else ["k", "t"]
        want, got = (sorted(map(str, detect.detect_asvotes(df, order, keys=keys, spread=s).collect())) for s in (False, True))
        assert got == want
    one = {s: {r.window_id: r.d for r in eigen.roll_svd(df.filter("k = 'a'"), "t", ["signal", "other"], 40, scale_=True, spread=s).collect()} for s in (False, True)}
    assert one[True].keys() == one[False].keys() and all(np.allclose(one[True][w], one[False][w], atol=1e-9) for w in one[True])


def long_panel(spark):
    rs = np.random.RandomState(5)
    rows = []
    for k, n in (("wave", 700), ("walk", 600), ("short", 9), (None, 90)):
        x, e = rs.normal(size=(2, n))
        y = 5 * np.sin(np.arange(n) * np.pi / 3) + e if k == "wave" else np.cumsum(e) if k == "walk" else e
        rows += [(k, i, float(a + b), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "k string, t long, y double, x double").repartition(7)


@pytest.mark.parametrize("order,options", [(None, {"period": 6, "max_p": 1, "max_q": 1}), ((1, 1, 1), {"period": 6, "seasonal_order": (0, 1, 0), "given": ([0.3], [-0.5])}), ((0, 0, 0), {})])
def test_arima_of_spread_series(spark, order, options):
    df = long_panel(spark)
    both = [arimax.arimax_residuals(df, "t", "y", "x", order, keys=["k"], spread=s, **options).orderBy("k", "time").collect() for s in (False, True)]
    assert len(both[0]) == len(both[1]) == 1399
    for a, b in zip(*both, strict=True):
        assert [a[c] for c in ("k", "time", *arimax.FITTED)] == [b[c] for c in ("k", "time", *arimax.FITTED)]
        assert abs(a["residual"] - b["residual"]) < 1e-7 and abs(a["aic"] - b["aic"]) < 1e-6
    if order is None:
        noise = np.array([tuple(r) for r in df.filter("k is null").orderBy("t").select("y", "x").collect()])
        z = np.column_stack([np.ones(90), noise[:, 1]])
        z = noise[:, 0] - z @ np.linalg.lstsq(z, noise[:, 0], rcond=None)[0]
        lrv = (z @ z + 2 * sum((1 - h / 4) * (z[h:] @ z[:-h]) for h in (1, 2, 3))) / 90
        rejected = int((np.cumsum(z) ** 2).sum() / 90**2 / lrv > arimax.CRITICAL)
        assert {r["k"]: (r["d"], r["seasonal_d"]) for r in both[1]} == {"wave": (0, 1), "walk": (1, 0), "short": (0, 0), None: (rejected, 0)}


def test_no_task_of_a_spread_fit_gets_a_series(spark):
    df = long_panel(spark)
    for got in (arimax.arimax_residuals(df, "t", "y", "x", (1, 1, 0), keys=["k"], spread=True, given=([0.5], [])), arimax.arx_residuals(df, "t", "y", "x", keys=["k"], spread=True), arimax.kpss(df, ["k"], "t", "y", spread=True), arimax.seasonal_strength(df, ["k"], "t", "y", 6, spread=True)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        # the only windows run within ranges, or over the few rows that stand for ranges: their counts (_n) and their totals (_t0)
        assert all("_part" in line or "sum(_n#" in line or "sum(_t0#" in line for line in plan.splitlines() if "Window [" in line), plan


def test_rows_before_by_their_positions(spark):
    df = spark.createDataFrame([(k, i, i * 10) for k in ("a", None) for i in range(1, 6)], "k string, p long, v long").withColumn("v", F.when(F.col("p") != 4, F.col("v")))
    got = with_before(df.select(F.struct("k").alias("key"), "p", "v"), "key", "p", [1, 3], ["v"])
    assert sorted((str(r["key"]["k"]), r["p"], r["v"], [b["v"] for b in r["_before"]]) for r in got.collect()) == [(k, p, v, b) for k in ("None", "a") for p, v, b in ((4, None, [30, 10]), (5, 50, [None, 20]))]


def test_rows_of_a_large_group_are_not_brought_together_for_its_median(spark, monkeypatch):
    monkeypatch.setattr(spread, "LARGE", 100, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("a", float(i % 37)) for i in range(900)] + [("b", float(i * i)) for i in range(101)]
        got = spread.robust_z(spark.createDataFrame(rows, "k string, v double"), "k", "v")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        mixed = rows + [("c", 1.0), ("c", 2.0), ("c", 4.0), ("d", None)]
        z = spread.robust_z(spark.createDataFrame(mixed, "k string, v double"), "k", "v").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(z) == len(mixed) and sorted(r.z for r in z if r.k == "c") == [-1, 0, 2]
    assert [r.z for r in z if r.k == "d"] == [None]
    for k in "ab":
        v = np.array([x for g, x in rows if g == k])
        off = v - np.median(v)
        assert np.allclose(sorted(r.z for r in z if r.k == k), sorted(off / np.median(np.abs(off))))


def test_ties_at_the_limit_follow_the_blocks_own_sums(spark):
    """In this series a z-score is 2 but for rounding errors."""
    y = [3.42, 6.22, 24.58, 29.97, 75.97, 10.95, 29.63, 19.48, 47.46, 1.03, 152.29, 114.35, 126.52, 41.18, 45.66, 12.47, 4.17, 12.6, 58.37, 10.38, 9.0, 107.17, 53.42, 2.35, 27.95, 37.11, 42.98, 18.08, 10.97, 46.68, 20.46, 40.61, 33.02, 30.36, 57.49, 7.96, 28.12, 24.72, 28.81, 38.83, 40.18, 6.94, 206.38, 66.21, 91.52, 122.77, 8.01, 19.38, 3.37, 75.1, 19.82, 22.82, 83.4, 21.89, 15.55, 10.07, 36.97, 22.77, 24.24, 88.16, 22.66, 18.74, 9.84, 90.59, 109.04, 172.16, 17.67, 27.91, 19.22, 41.1, 36.65, 42.41, 0.16, 12.25, 40.34, 153.99, 22.53, 4.9, 0.83, 18.95, 8.37, 26.21, 40.71]
    low, high, n = 5, max(5, len(y) // 3), len(y)
    want = np.zeros(n)
    for w in range(low, high + 1):
        pad, slopes = n % w // 2, []
        for b in range(n // w):
            total = 0.0
            for j in range(w):
                total += (j + 1 - (w + 1) / 2) * y[pad + w * b + j]
            slopes.append(total / (w * (w * w - 1) / 12))
        off = np.array(slopes) - np.median(slopes)
        for b in np.flatnonzero(off / np.median(np.abs(off)) > 2):
            want[pad + w * b : pad + w * (b + 1)] += 1
    df = spark.createDataFrame(list(enumerate(y)), "t long, signal double")
    got = [r.score for r in detect.detect_asvotes(df, ["t"], mad_k=2).orderBy("t").collect()]
    assert np.allclose(got, want / (high - low + 1))
