"""Covariances of sliding windows over many columns, from running sums of outer products, and their spectra.

A series is cut into blocks of consecutive rows; a block takes along the ``window - 1`` rows before it, so that each block is worked off by
itself: a long series is many tasks, and the plan doesn't grow with the number of columns. Expanding windows take along the sums of all blocks
before, which are window aggregates over (block, entry of the sums).

Within a block the outer product of each row that enters is added and that of the row that leaves is subtracted; rows are shifted by their
mean first. A window in which a column hardly varies, compared with its block, is summed up again from its own rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at least, entries of the running sums held at a time.
ROWS, ENTRIES = 512, 1 << 21
#: From so many columns on, few leading eigenvalues (a sixteenth of the columns at most) come from subspace iteration.
WIDE = 256
#: Below this share of its block's variance, a window's variance is computed from its own rows.
NOISE = 1e-6


def design(x: np.ndarray, shift: np.ndarray, complete: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose outer products hold counts, sums and products (of complete rows, or of all pairs of present values), and which rows hold an infinite value that counts."""
    seen, odd = ~np.isnan(x), np.isinf(x)
    whole = seen.all(axis=1)
    value = np.where(seen & ~odd, x - shift, 0.0)
    if complete:
        return np.where(whole[:, None], np.column_stack([np.ones(len(x)), value]), 0.0), odd.any(axis=1) & whole
    return np.hstack([seen.astype(float), value]), odd.any(axis=1)


def mean_of(x: np.ndarray) -> np.ndarray:
    """The mean of each column's finite values, 0 where there is none."""
    some = np.isfinite(x)
    return np.where(some, x, 0.0).sum(axis=0) / np.maximum(1, some.sum(axis=0))


def covariance(sums: np.ndarray, rows: np.ndarray, complete: bool, impute: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From stacked sums of outer products: covariances, the numbers of rows that count, and means (of shifted columns)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if complete:
            n = sums[:, 0, 0]
            mean = sums[:, 0, 1:] / n[:, None]
            return (sums[:, 1:, 1:] - mean[:, :, None] * sums[:, :1, 1:]) / (n - 1)[:, None, None], n, mean
        p = sums.shape[1] // 2
        both, own, product = sums[:, :p, :p], sums[:, p:, :p], sums[:, p:, p:]
        count = np.diagonal(both, axis1=1, axis2=2)
        mean = np.diagonal(own, axis1=1, axis2=2) / count
        if impute:
            a, b = mean[:, :, None], mean[:, None, :]
            cov = (product - b * own - a * np.swapaxes(own, 1, 2) + both * a * b) / (rows - 1)[:, None, None]
            return np.where((count > 1).all(axis=1)[:, None, None], cov, np.nan), rows, mean
        cov = (product - own * np.swapaxes(own, 1, 2) / both) / (both - 1)
        return np.where(both > 1, cov, np.nan), rows, mean


def leading(s: np.ndarray, k: int, most: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors (as rows) of stacked matrices without large negative ones, by blocked subspace iteration.

    A matrix whose residuals don't fall below 1e-10 of its largest eigenvalue is decomposed as a whole.
    """
    m, p, _ = s.shape
    q = np.broadcast_to(np.linalg.qr(np.random.RandomState(1).randn(p, min(p, k + 8)))[0], (m, p, min(p, k + 8)))
    d, v, open_ = np.zeros((m, k)), np.zeros((m, k, p)), np.arange(m)
    for step in range(most):
        q = np.linalg.qr(s[open_] @ q)[0]
        if step % 4 == 3:
            sq = s[open_] @ q
            value, turn = np.linalg.eigh(np.swapaxes(q, 1, 2) @ sq)
            value, turn = value[:, ::-1][:, :k], turn[:, :, ::-1]
            q, sq = q @ turn, sq @ turn
            left = np.linalg.norm(sq[:, :, :k] - q[:, :, :k] * value[:, None, :], axis=1).max(axis=1)
            done = left <= 1e-10 * np.abs(value[:, 0])
            d[open_[done]], v[open_[done]] = value[done], np.swapaxes(q[done][:, :, :k], 1, 2)
            open_, q = open_[~done], q[~done]
            if not len(open_):
                return d, v
    value, vector = np.linalg.eigh(s[open_])
    d[open_], v[open_] = value[:, ::-1][:, :k], np.swapaxes(vector[:, :, ::-1], 1, 2)[:, :k]
    return d, v


def signed(v: np.ndarray) -> np.ndarray:
    """Stacked vectors (the last axis) with a positive entry of largest size, the first of equals."""
    lead = np.take_along_axis(v, np.argmax(np.round(np.abs(v), 12), axis=-1)[..., None], axis=-1)
    return np.where(lead < 0, -v, v)


def spectrum(cov: np.ndarray, k: int, vectors: bool, fast: bool, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray | None]:
    """Eigenvalues, largest first, and vectors: the k leading ones where that is faster, else all."""
    if fast and cov.shape[1] >= wide and 16 * k <= cov.shape[1]:
        d, v = leading(cov, k)
        return d, signed(v) if vectors else None
    if not vectors:
        return np.linalg.eigvalsh(cov)[:, ::-1], None
    d, v = np.linalg.eigh(cov)
    return d[:, ::-1], signed(np.swapaxes(v[:, :, ::-1], 1, 2))


class Block:
    """What ``roll_svd`` asks of each window, and the work on one block of rows."""

    def __init__(self, p: int, window: int, step: int, expanding: bool, policy: str, on_pairs: bool, scale: bool, k: int | None, vectors: bool, fast: bool, wide: int = WIDE):
        self.p, self.window, self.step, self.expanding, self.scale, self.k, self.vectors = p, window, step, expanding, scale, k, vectors
        self.impute, self.pairs = policy == "impute_mean", policy == "pairwise_complete"
        self.complete = policy == "omit_rows" or (self.pairs and not on_pairs)
        self.fast, self.wide = fast and policy == "omit_rows", wide

    def ends(self, first: int, lead: int, rows: int, n: int) -> np.ndarray:
        """Which rows of a block, from 0, end a window."""
        pos = np.arange(first + lead, first + rows)
        return np.flatnonzero((pos == n) if n < self.window else (pos >= self.window) & ((pos - self.window) % self.step == 0)) + lead

    def covariances(self, x: np.ndarray, lead: int, first: int, ends: np.ndarray, shift: np.ndarray, before: np.ndarray | None, complete: bool):
        """(ends, covariances, rows that count, means, infinite) of slices of a block's windows."""
        z, odd = design(x, shift, complete)
        q = z.shape[1]
        total, bad = z[:lead].T @ z[:lead], int(odd[:lead].sum())
        if before is not None:
            total, bad = total + before[:-1].reshape(q, q), bad + int(before[-1])
        spread = (z * z).sum(axis=0)[1:] if complete else (z * z).sum(axis=0)[q // 2 :]
        size = max(1, ENTRIES // (2 * self.p) ** 2)
        for at in range(lead, len(x), size):
            own = slice(at, min(len(x), at + size))
            gone = np.arange(own.start, own.stop) - self.window
            outer = np.einsum("ti,tj->tij", z[own], z[own])
            lost = odd[own].astype(np.int64)
            if not self.expanding and (some := gone >= 0).any():
                y = z[gone[some]]
                outer[some] -= np.einsum("ti,tj->tij", y, y)
                lost[some] -= odd[gone[some]]
            outer[0] += total
            sums, bads = np.cumsum(outer, axis=0), bad + np.cumsum(lost)
            total, bad = sums[-1].copy(), int(bads[-1])
            here = ends[(ends >= own.start) & (ends < own.stop)]
            if not len(here):
                continue
            sums = sums[here - own.start]
            pos = first + here
            rows = (pos if self.expanding else np.minimum(pos, self.window)).astype(float)
            cov, n, mean = covariance(sums, rows, complete, self.impute)
            var = np.diagonal(cov, axis1=1, axis2=2)
            if self.expanding:
                flat = var <= 1e-12 * np.maximum(mean * mean, 1e-300)
                cov = np.where(flat[:, :, None] | flat[:, None, :], 0.0, cov) if flat.any() else cov
            else:
                close = (var <= NOISE * spread / max(1, len(x) - 1)) & (n[:, None] > 1)
                for i in np.flatnonzero(close.any(axis=1)):
                    own_x = x[max(0, here[i] + 1 - self.window) : here[i] + 1]
                    mid = mean_of(own_x)
                    y, _ = design(own_x, mid, complete)
                    again, _, m = covariance((y.T @ y)[None], rows[i : i + 1], complete, self.impute)
                    cov[i], mean[i] = again[0], m[0] + mid - shift
            yield here, cov, n, mean + shift, bads[here - own.start] > 0

    def work(self, x: np.ndarray, lead: int, first: int, n: int, shift: np.ndarray | None = None, before: np.ndarray | None = None) -> list[dict]:
        """(pos, n_w, d, v) of the windows that end in a block; d is missing where a window is skipped."""
        ends = self.ends(first, lead, len(x), n)
        if not len(ends):
            return []
        if shift is None:
            shift = mean_of(x)
        out, cut = [], (self.p + 1) ** 2 + 1
        both = self.pairs and self.complete
        extra = self.covariances(x, lead, first, ends, shift, before[cut:] if before is not None else None, False) if both else None
        slices = self.covariances(x, lead, first, ends, shift, before[:cut] if both and before is not None else before, self.complete)
        for here, cov, rows, mean, odd in slices:
            var = np.diagonal(cov, axis1=1, axis2=2)
            count = rows if not self.pairs else np.minimum(first + here, self.window if not self.expanding else first + here).astype(float)
            if extra is not None:
                _, other, _, mean, also = next(extra)
                var, odd = np.diagonal(other, axis1=1, axis2=2), odd | (also & self.scale)
            if self.scale:
                sd = np.sqrt(np.maximum(np.nan_to_num(var), 0.0))
                sd = np.where(sd > 1e-12 * np.abs(np.nan_to_num(mean)), sd, 1.0)
                cov = cov / (sd[:, :, None] * sd[:, None, :])
            good = np.isfinite(cov).all(axis=(1, 2)) & (count > 1) & ~odd
            size = np.maximum(1, np.minimum(np.minimum(self.p if self.k is None else self.k, count), self.p)).astype(int)
            d, v = spectrum(cov[good], int(size.max()), self.vectors, self.fast, self.wide) if good.any() else (None, None)
            nth = np.cumsum(good) - 1
            for i, at in enumerate(here.tolist()):
                row = {"pos": first + at, "n_w": int(count[i]), "d": d[nth[i], : size[i]].tolist() if good[i] else None}
                if self.vectors:
                    row["v"] = v[nth[i], : size[i]].tolist() if good[i] else None
                out.append(row)
        return out

    def sums(self, x: np.ndarray, shift: np.ndarray) -> list[float]:
        """A block's own sums of outer products, and the rows with an infinite value; of complete rows and of pairs, where both are needed."""
        out = []
        for complete in [self.complete, False][: 1 + (self.pairs and self.complete)]:
            z, odd = design(x, shift, complete)
            out += [*(z.T @ z).ravel().tolist(), float(odd.sum())]
        return out


def spectra(series: DataFrame, cols: list[str], block: Block, rows: int = ROWS) -> DataFrame:
    """(key, n, pos, n_w, d[, v]) of every window of ``series`` (key, pos, n and ``cols``), NULL where it is skipped."""
    p, w = block.p, block.window
    size = max(rows, w)
    x = F.transform(F.array(*map(F.col, cols)), lambda v: F.coalesce(v, F.lit(float("nan"))))
    mean = [F.coalesce(F.avg(F.when(F.abs(F.col(c)) < float("inf"), F.col(c))).over(Window.partitionBy("key")), F.lit(0.0)) for c in cols if block.expanding]
    own = series.select("key", "pos", "n", x.alias("x"), F.expr(f"(pos - 1) div {size}").alias("block"), F.array(*mean).alias("shift"))
    if not block.expanding:
        later = (F.col("pos") > (F.col("block") + 1) * size - (w - 1)) & ((F.col("block") + 1) * size < F.col("n"))
        own = own.withColumn("block", F.explode(F.when(later, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
    rows_of = F.sort_array(F.collect_list(F.struct("pos", "x")))
    packed = own.groupBy("key", "block").agg(rows_of.alias("r"), F.max("n").alias("n"), F.first("shift").alias("shift"))
    packed = packed.select("key", "block", "n", F.get("r.pos", F.lit(0)).alias("first"), F.flatten("r.x").alias("flat"), "shift")
    result = "array<struct<pos: bigint, n_w: bigint, d: array<double>" + (", v: array<array<double>>>>" if block.vectors else ">>")

    @F.pandas_udf(result)
    def rolling(number: pd.Series, first: pd.Series, n: pd.Series, flat: pd.Series) -> pd.Series:
        return pd.Series([block.work(np.asarray(f, float).reshape(-1, p), int(b * size + 1 - at), int(at), int(m)) for b, at, m, f in zip(number, first, n, flat, strict=True)], dtype=object)

    @F.pandas_udf("array<double>")
    def summed(flat: pd.Series, shift: pd.Series) -> pd.Series:
        return pd.Series([block.sums(np.asarray(f, float).reshape(-1, p), np.asarray(s, float)) for f, s in zip(flat, shift, strict=True)], dtype=object)

    @F.pandas_udf(result)
    def expanding(first: pd.Series, n: pd.Series, flat: pd.Series, shift: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([block.work(np.asarray(f, float).reshape(-1, p), 0, int(at), int(m), np.asarray(s, float), None if b is None or not len(b) else np.asarray(b, float)) for at, m, f, s, b in zip(first, n, flat, shift, before, strict=True)], dtype=object)

    if not block.expanding:
        got: Column = rolling("block", "first", "n", "flat")
    else:
        entries = packed.select("key", "block", F.posexplode(summed("flat", "shift")).alias("at", "v"))
        prior = Window.partitionBy("key", "at").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        entries = entries.withColumn("v", F.sum("v").over(prior)).filter("v is not null")
        before = entries.groupBy("key", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("before"))
        packed = packed.join(before, ["key", "block"], "left")
        got = expanding("first", "n", "flat", "shift", "before")
    return packed.select("key", "n", F.explode(got).alias("w")).select("key", "n", "w.*")
