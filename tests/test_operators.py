"""Edges and properties of the time-series operators on small series."""

import datetime as dt

import numpy as np
import pytest

from rampwise.operators import arimax, detect, eigen, series, signals, windows
from rampwise.sources.sinks import first_detection, overlay_frame, write_rt_csv
from rampwise.streaming.realtime import detect_stream, prefix_score


def frame(spark, *cols, names="xyz"):
    rows = [(i, *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(zip(*cols, strict=True))]
    return spark.createDataFrame(rows, "t long, " + ", ".join(f"{c} double" for c in names[: len(cols)]))


def test_windows_of_short_and_empty_series(spark):
    empty = series.positioned(spark.createDataFrame([], "t long"), ["t"])
    assert windows.roll_windows(empty, "t", 3).count() == 0
    short = series.positioned(spark.range(2).toDF("t"), ["t"])
    assert [tuple(r)[:4] for r in windows.roll_windows(short, "t", 5).collect()] == [(1, 1, 2, 1)]
    for bad in ({"window": 0}, {"window": 2, "step": 0}, {"window": 2, "align": "x"}, {"window": 2, "type": "x"}):
        with pytest.raises(ValueError):
            windows.roll_windows(short, "t", **bad)


def test_selection_and_coercion(spark):
    values = ["1", " 2 ", "1e3", "inf", "x", "", "0x10", "1_000", "1d", "NaN"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a string, i int")
    got = [r.a for r in series.extract_x(df, "a", ("i",)).orderBy("i").collect()]
    assert got == [1.0, 2.0, 1000.0, float("inf"), None, None, None, None, None, None]
    assert series.resolve(spark.createDataFrame([], "xtemp int, volt int, b int"), "temp|volt") == ["xtemp", "volt"]
    for bad, kind in ((["zz"], KeyError), (["a", "a"], TypeError), ([], ValueError), (5, ValueError)):
        with pytest.raises(kind):
            series.resolve(df, bad)


def test_eigenvalues_against_numpy(spark):
    x = np.random.RandomState(0).normal(size=(4, 30))
    df = frame(spark, *x, names="abcd")
    for p in (1, 2, 3, 4):
        got = eigen.roll_svd(df, "t", list("abcd"[:p]), 10).orderBy("window_id").collect()
        assert len(got) == 21
        for r in got:
            want = np.linalg.eigvalsh(np.atleast_2d(np.cov(x[:p, r.start - 1 : r.end])))[::-1]
            assert np.allclose(r.d, want, atol=1e-9)
    full = eigen.roll_svd(df, "t", list("abcd"), 10, k=2, values_only=False)
    r = full.filter("window_id = 3").head()
    c = np.cov(x[:, 2:12])
    assert np.allclose(c @ np.array(r.v[0]), r.d[0] * np.array(r.v[0]), atol=1e-8) and len(r.d) == 2
    assert eigen.scores(df, full, "t", list("abcd")).count() == 21 * 10 * 2


def test_skipped_windows_and_constant_columns(spark):
    df = frame(spark, [1, None, None, 4, 5, 7], [0.1] * 6, names="ab")
    got = eigen.roll_svd(df, "t", ["a", "b"], 3, scale_=True).orderBy("window_id").collect()
    assert got[0].d is None and got[3].n_w == 3 and np.allclose(got[3].d, [1, 0], atol=1e-9)
    assert eigen.tidy_values(eigen.roll_svd(df, "t", ["a", "b"], 3)).filter("window_id = 1").count() == 0


def test_arimax_recovers_an_autoregression(spark):
    rs = np.random.RandomState(1)
    x, e, u = rs.normal(size=600), rs.normal(size=600) * 0.5, np.zeros(600)
    for t in range(1, 600):
        u[t] = 0.7 * u[t - 1] + e[t]
    df = frame(spark, 2 * x + u, x, names="yx")
    got = arimax.arimax_residuals(df, "t", "y", "x").collect()
    r = np.array([g.residual for g in sorted(got, key=lambda g: g.time)])
    assert abs(np.corrcoef(r[1:], r[:-1])[0, 1]) < 0.1 and r.std() < 0.55
    one = arimax.arimax_residuals(df, "t", "y", "x", order=(1, 0, 0)).head()
    assert abs(one.params[1] - 2) < 0.1 and abs(one.params[2] - 0.7) < 0.1
    assert signals.build_signal_arimax_resid(df, "t", "y", "x", order=(0, 1, 1)).count() == 600


def noisy(n=150, seed=3):
    rs = np.random.RandomState(seed)
    y = rs.normal(size=n)
    y[100:112] += np.arange(12) * 3
    y[112:] += 33
    return y


def test_votes(spark):
    y = noisy()
    df = frame(spark, y, names=["signal"])
    score = lambda d, **o: np.array([r.score for r in detect.detect_asvotes(d, ["t"], **o).orderBy("t").collect()])
    up = score(df)
    assert 100 <= up.argmax() <= 112 and up.max() > 0 and np.abs(up).max() <= 1
    assert np.allclose(up, score(frame(spark, -y, names=["signal"]), direction="negative"))
    assert np.allclose(score(df, direction="both"), up - score(df, direction="negative"))
    assert score(frame(spark, [1, 2], names=["signal"])).tolist() == [0, 0]
    assert detect.detect_asvotes(spark.createDataFrame([], "t long, signal double"), ["t"]).count() == 0
    with pytest.raises(ValueError):
        detect.detect_asvotes(df, ["t"], direction="up")


def test_realtime_stream_and_sinks(spark, tmp_path):
    y = noisy()
    df = frame(spark, y, names=["signal"])
    got = detect.detect_realtime(df, "t", threshold=0.02, burn_in=50).orderBy("time_ind").collect()
    sums = np.zeros((3, 1))
    for i, v in enumerate(y):
        sums = np.column_stack([sums, sums[:, -1] + [v, i * v, 0]])
        if i >= 50:
            assert abs(prefix_score(sums, 5, "auto", 3.0, "positive", 30) - got[i].detected_value_rt) < 1e-9
    flagged = [r.time_ind for r in got if r.flag]
    assert flagged and {r.first_detection_time for r in got} == {flagged[0]}
    out = spark.createDataFrame(got)
    assert first_detection(out).head()[0] == flagged[0]
    o = overlay_frame(out).collect()
    assert np.isclose(max(r.scaled_signal for r in o) - min(r.scaled_signal for r in o), max(r.score for r in o) - min(r.score for r in o))
    write_rt_csv(out, f"file://{tmp_path}/csv", True)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 150
    df.selectExpr("1L as k", "t", "signal").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = detect_stream(spark.readStream.schema("k long, t long, signal double").parquet(f"file://{tmp_path}/in"), "k", "t", "signal", burn_in=50)
    q = stream.writeStream.format("memory").queryName("rt").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    live = {r.time_ind: r.detected_value_rt for r in spark.table("rt").collect()}
    assert all(abs(live[r.time_ind] - r.detected_value_rt) < 1e-9 for r in got[50:]) and len(live) == 100


def test_time_types_are_kept(spark):
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(noisy())]
    got = detect.detect_realtime(spark.createDataFrame(rows, "t timestamp, signal double"), "t", threshold=0.02)
    assert dict(got.dtypes)["first_detection_time"] == "timestamp" and got.count() == 150
