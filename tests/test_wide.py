"""Sliding covariances of many columns against numpy: policies, scaling, blocks, expanding windows, leading eigenvalues."""

import numpy as np
import pandas as pd
import pytest

from rampwise.operators import eigen, moments


def table(n=90, p=6, seed=1, holes=0.1):
    rng = np.random.RandomState(seed)
    x = np.cumsum(rng.randn(n, p), axis=0) * (1 + np.arange(p)) + 50
    x[:, 1] = x[:, 0] * 0.5 + rng.randn(n)
    x[30:60, 2] = 7.25  # constant within whole windows
    x[rng.rand(n, p) < holes] = np.nan
    return x


def window_of(x, policy, on_pairs, scale):
    """Covariance and count of one window, the plain way; None where it is skipped."""
    frame = pd.DataFrame(x)
    rows, whole = frame, frame.dropna()
    if policy == "omit_rows":
        rows = whole
    elif policy == "impute_mean":
        rows = frame.fillna(frame.mean()[frame.notna().sum() > 1])
    if len(rows) < 2:
        return len(rows), None
    if scale:
        sd = rows.std()
        sd = sd.where(sd > 1e-12 * rows.mean().abs(), np.nan).fillna(1.0)
        rows = (rows - rows.mean()) / sd
    cov = (rows.dropna() if policy == "pairwise_complete" and not on_pairs else rows).cov(min_periods=2).to_numpy()
    if policy == "impute_mean" and rows.isna().any().any():
        return len(rows), None
    return len(rows), cov if np.isfinite(cov).all() else None


@pytest.mark.parametrize("policy,on_pairs,scale,kind,step", [("omit_rows", True, False, "rolling", 1), ("omit_rows", True, True, "rolling", 1), ("omit_rows", True, False, "expanding", 3), ("impute_mean", True, True, "rolling", 2), ("impute_mean", True, False, "expanding", 1), ("pairwise_complete", True, True, "rolling", 1), ("pairwise_complete", False, True, "rolling", 1), ("pairwise_complete", False, True, "expanding", 1), ("pairwise_complete", True, False, "expanding", 5)])
def test_policies_in_blocks(spark, monkeypatch, policy, on_pairs, scale, kind, step):
    monkeypatch.setattr(moments.spectra, "__defaults__", (16,))
    x, w = table(), 12
    names = ["a.b", "t", "x0", "pos", "key", "d"]
    rows = [(i, "k", *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)] + [(i, None, *(float(v) for v in np.arange(6) * i % 5)) for i in range(5)]
    df = spark.createDataFrame(rows, "at long, who string, " + ", ".join(f"`{c}` double" for c in names)).repartition(3)
    got = eigen.roll_svd(df, "at", names, w, step=step, type=kind, scale_=scale, na_action=policy, cov_on_pairwise=on_pairs, keys=["who"]).orderBy("who", "end").collect()
    assert [r["end"] for r in got if r["who"] is None] == [5]
    got = [r for r in got if r["who"] == "k"]
    assert [r["end"] for r in got] == list(range(w, len(x) + 1, step))
    for r in got:
        n, cov = window_of(x[r["start"] - 1 : r["end"]], policy, on_pairs, scale)
        assert r["n_w"] == n and (r["d"] is None) == (cov is None), r
        if cov is not None:
            want = np.linalg.eigvalsh(cov)[::-1][: min(6, n)]
            assert np.allclose(r["d"], want, rtol=1e-8, atol=1e-8 * abs(want).max()), (r["end"], r["d"], want)


def test_infinite_values_skip_their_windows_only(spark):
    x = table(40, 5, holes=0)
    x[20, 3] = np.inf
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t int, a double, b double, c double, d double, e double")
    got = {r["end"]: r["d"] for r in eigen.roll_svd(df, "t", ["a", "b", "c", "d", "e"], 8).collect()}
    assert all((got[e] is None) == (21 <= e <= 28) for e in got)
    assert np.allclose(got[40], np.linalg.eigvalsh(np.cov(x[32:40].T))[::-1][:8], rtol=1e-8)


def test_vectors_of_many_columns(spark):
    x = table(60, 33, holes=0)
    names = [f"c{i}" for i in range(33)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t int, " + ", ".join(f"{c} double" for c in names))
    for r in eigen.roll_svd(df, "t", names, 50, step=5, k=3, values_only=False).collect():
        cov = np.cov(x[r["start"] - 1 : r["end"]].T)
        d, v = np.array(r["d"]), np.array(r["v"])
        assert d.shape == (3,) and np.allclose(d, np.linalg.eigvalsh(cov)[::-1][:3], rtol=1e-9)
        assert np.allclose(cov @ v.T, v.T * d, atol=1e-6 * d[0]) and (np.take_along_axis(v, abs(v).argmax(1)[:, None], 1) > 0).all()


def test_leading_eigenvalues_by_subspace_iteration():
    rng = np.random.RandomState(3)
    x = rng.randn(5, 80, 40) * np.r_[20, 10, 6, np.ones(37)]
    x[4] = rng.randn(80, 40)  # a flat spectrum
    s = np.stack([np.cov(y.T) for y in x])
    d, v = moments.leading(s, 2)
    assert np.allclose(d, np.linalg.eigvalsh(s)[:, ::-1][:, :2], rtol=1e-9)
    assert np.allclose(np.einsum("mij,mkj->mki", s, v), v * d[:, :, None], atol=1e-7)
    fast, vectors = moments.spectrum(s, 2, True, True, wide=32)
    assert np.allclose(fast, d, rtol=1e-9) and vectors.shape == (5, 2, 40)


def test_many_columns_keep_the_plan_small(spark):
    names = [f"c{i}" for i in range(128)]
    df = spark.createDataFrame([(i, *([float(i % 7)] * 128)) for i in range(20)], "t int, " + ", ".join(f"{c} double" for c in names))
    got = eigen.roll_svd(df, "t", names, 10, k=1)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert len(got.collect()) == 11
