"""Columns with the names that the operators use inside, keys that are NULL, and the keyed forms."""

import numpy as np
import pytest

from rampwise.operators import detect, eigen, series, windows

RS = np.random.RandomState(7)


def table(spark, n=60, names=("x", "y"), keys=(None,)):
    rows = [(k, i, *map(float, RS.normal(size=len(names)))) for k in keys for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, " + ", ".join(f"`{c}` double" for c in names))


@pytest.mark.parametrize("names", [("n", "pos"), ("s_0_0", "sd_0"), ("key", "time"), ("o0", "x0"), ("a.b", "window_id")])
def test_eigenvalues_of_sensors_of_any_name(spark, names):
    df = table(spark, names=names)
    x = np.array([[r[names[0]], r[names[1]]] for r in df.orderBy("t").collect()]).T
    for align in ("end", "start"):
        got = eigen.roll_svd(df, "t", list(names), 10, align=align).orderBy("window_id").collect()
        assert len(got) == 51
        for r in got:
            assert np.allclose(r.d, np.linalg.eigvalsh(np.cov(x[:, r.start - 1 : r.end]))[::-1], atol=1e-9)
    full = eigen.roll_svd(df, "t", list(names), 10, values_only=False)
    assert eigen.scores(df, full, "t", list(names)).count() == 51 * 10 * 2


def test_positions_never_overwrite(spark):
    with pytest.raises(ValueError):
        series.positioned(table(spark, names=("n", "v")), ["t"])
    with pytest.raises(ValueError):
        eigen.roll_svd(table(spark).withColumnRenamed("k", "start"), "t", ["x", "y"], 5, keys=["start"])


def ramp(seed):
    y = np.random.RandomState(seed).normal(size=150)
    y[100:112] += np.arange(12) * 3
    y[112:] += 33
    return y.tolist()


def test_votes_keep_the_columns_of_the_caller(spark):
    y = ramp(3)
    rows = [(t, v, 10 * t, -t, t / 2, "q") for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "t long, signal double, i long, n long, y double, `a.b` string")
    plain = {r.t: r.score for r in detect.detect_asvotes(df.select("t", "signal"), ["t"]).collect()}
    got = detect.detect_asvotes(df, ["t"])
    assert got.columns == [*df.columns, "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((*r, plain[r[0]]) for r in rows) and max(plain.values()) > 0.5
    for name in ("i", "n", "y"):
        renamed = df.select("t", df.signal.alias(name))
        assert {r.t: r.score for r in detect.detect_asvotes(renamed, ["t"], name).collect()} == plain


def test_null_keys_are_keys(spark):
    rows = [(k, t, v) for k, seed in (("a", 3), (None, 3), ("b", 4)) for t, v in enumerate(ramp(seed))]
    df = spark.createDataFrame(rows, "k string, t long, signal double")
    got = detect.detect_asvotes(df, ["t"], keys=["k"]).collect()
    by = lambda k: sorted((r.t, r.score) for r in got if r.k == k)
    assert by(None) == by("a") != by("b") and len(got) == 450
    live = detect.detect_realtime(df, "t", keys=["k"], threshold=0.02, burn_in=60).collect()
    of = lambda k: sorted((r.time_ind, r.signal, r.detected_offline, r.detected_value_rt, r.flag, r.first_detection_time) for r in live if r.k == k)
    alone = detect.detect_realtime(df.filter("k = 'a'").drop("k"), "t", threshold=0.02, burn_in=60).collect()
    assert of(None) == of("a") == sorted(map(tuple, alone))
    for align in ("end", "start", "center"):
        wins = windows.roll_windows(series.positioned(df, ["t"], ["k"]), "t", 10, align=align, keys=["k"]).collect()
        assert [sum(r.k == k for r in wins) for k in ("a", None, "b")] == [141] * 3
        values = eigen.roll_svd(df, "t", ["signal"], 10, align=align, keys=["k"]).collect()
        of_key = lambda k: sorted((r.window_id, r.t_rep, tuple(r.d)) for r in values if r.k == k)  # noqa: B023, E731
        assert of_key(None) == of_key("a") and len(values) == 423
    full = eigen.roll_svd(df, "t", ["signal"], 10, values_only=False, keys=["k"])
    assert eigen.scores(df, full, "t", ["signal"], keys=["k"]).groupBy("k").count().count() == 3
    assert eigen.tidy_loadings(full, ["signal"], ["k"]).count() == eigen.tidy_values(full, ["k"]).count() == 423
