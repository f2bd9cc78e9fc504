"""ARMA errors of any number of series, long ones in many blocks of rows.

Estimates are those of Hannan and Rissanen: a long autoregression gives proxies of the errors, and the series is regressed on its own lags and
those of the proxies. All least squares come from Gram matrices that are summed over blocks, so that no series is gathered
in one place; each block brings along as many rows before it as the lags need. Where the order isn't given, one Gram matrix with all lags yields
every candidate's sum of squares, and the least AIC decides.

Seasonal parts are factors: the lag polynomial of a side is the product of its own and its seasonal one. A sum of squares under such products needs no
more than the same Gram matrix, so that Gauss-Newton steps run over a few numbers for each series and never over its rows.

The errors e(t) = c(t) - sum of ma(j) e(t - j) are a recurrence. A block's last errors are an affine map of the last errors of the block before; these maps
are put together over a series' blocks (a few numbers for each block), and then every block starts from its own right state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.functions.linear import DEPENDENT
from rampwise.sources.scratch import written

#: Rows of a block, the lags of the long autoregression, and the largest modulus of a root of the moving average.
ROWS, LONG, LARGEST = 512, 20, 0.98
#: Gauss-Newton steps at most, and the seasons that the long autoregression reaches back where errors of earlier seasons are sought.
STEPS, SEASONS = 50, 3


def solved(gram: np.ndarray, some: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients of the last variable on ``some`` of the others, and the sum of squares that is left; dependent ones are 0."""
    at = [*some, len(gram) - 1]
    g = gram[np.ix_(at, at)].copy()
    out = np.zeros(len(some))
    first, used = np.diag(g).copy(), []
    for k in range(len(some)):
        if g[k, k] > DEPENDENT * first[k]:
            used.append(k)
            g[k] /= g[k, k]
            other = np.arange(len(g)) != k
            g[other] -= np.outer(g[other, k], g[k])
    out[used] = g[used, -1]
    return out, float(max(g[-1, -1], 0.0))


def lagged(u: np.ndarray, lags: list[int]) -> np.ndarray:
    """A column for each lag, zeros before the start."""
    out = np.zeros((len(u), len(lags)))
    for i, k in enumerate(lags):
        out[k:, i] = u[: max(0, len(u) - k)]
    return out


def invertible(ma: np.ndarray) -> np.ndarray:
    """The coefficients of lags 1, 2, .. drawn in so that the recurrence dies away."""
    if not ma.any():
        return ma
    companion = np.eye(len(ma), k=-1)
    companion[0] = -ma
    largest = np.abs(np.linalg.eigvals(companion)).max()
    return ma * (LARGEST / largest) ** np.arange(1, len(ma) + 1) if largest > LARGEST else ma


def recurrence(c: np.ndarray, ma: np.ndarray, state: np.ndarray) -> np.ndarray:
    """e of each row of c (a block) with its coefficients and its state: the errors before the start, the latest first."""
    m, q = ma.shape
    e = np.concatenate([state[:, ::-1], np.zeros_like(c)], axis=1)
    used = np.flatnonzero(ma.any(axis=0))
    for t in range(c.shape[1]):
        e[:, q + t] = c[:, t] - sum(ma[:, j] * e[:, q + t - 1 - j] for j in used)
    return e[:, q:]


def blocks(rows: DataFrame, lead: int, size: int) -> DataFrame:
    """(by, block, lead, n, pos, u): a series' rows (by, pos, n, u) in blocks, with ``lead`` rows before each."""
    own = rows.select("by", "pos", "n", "u", F.expr(f"(pos - 1) div {size}").alias("block"))
    later = (F.col("pos") > (F.col("block") + 1) * size - lead) & ((F.col("block") + 1) * size < F.col("n"))
    own = own.withColumn("block", F.explode(F.when(later, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
    packed = own.groupBy("by", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "u"))).alias("r"), F.max("n").alias("n"))
    return packed.select("by", "block", (F.col("block") * size + 1 - F.get("r.pos", F.lit(0))).alias("lead"), "n", F.col("r.pos").alias("pos"), F.col("r.u").alias("u"))


def summed(df: DataFrame, arrays: str) -> DataFrame:
    """(by, g): the sum of arrays of equal length over each series."""
    long = df.select("by", F.posexplode(arrays).alias("at", "v")).groupBy("by", "at").agg(F.sum("v").alias("v"))
    return long.groupBy("by").agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"].alias("g"))


class Order:
    """The lags of the AR and the MA side, and those of the seasonal factor of each: (1 - sum a B^i)(1 - sum A B^k) u = (1 + sum b B^j)(1 + sum B' B^l) e."""

    def __init__(self, ar: list[int], ma: list[int], seasonal_ar: list[int] = (), seasonal_ma: list[int] = ()):
        self.sides = [(list(ar), list(seasonal_ar), -1.0), (list(ma), list(seasonal_ma), 1.0)]
        self.sizes = (len(ar), len(ma), len(seasonal_ar), len(seasonal_ma))
        self.n = sum(self.sizes)
        self.linear = all(not own or not far for own, far, _ in self.sides)

    def lags(self, side: int) -> list[int]:
        """All lags of a side's product."""
        own, far, _ = self.sides[side]
        return sorted({*own, *far, *(i + k for i in own for k in far)})

    def design(self, lags: tuple[list[int], list[int]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The products' coefficients at the ``lags`` of both sides, and their derivatives by the parameters x: each side's own ones, then its seasonal ones."""
        width = len(lags[0]) + len(lags[1])
        beta, slopes, at, base = np.zeros(width), np.zeros((width, self.n)), 0, 0
        for (own, far, sign), known in zip(self.sides, lags, strict=True):
            place = {k: base + i for i, k in enumerate(known)}
            one, two = x[at : at + len(own)], x[at + len(own) : at + len(own) + len(far)]
            for i, a in enumerate(own):
                slopes[place[a], at + i] += 1
                for k, b in enumerate(far):
                    slopes[place[a + b], at + i] += sign * two[k]
                    slopes[place[a + b], at + len(own) + k] += sign * one[i]
            for k, b in enumerate(far):
                slopes[place[b], at + len(own) + k] += 1
            # the products are counted by both factors' slopes, once too often
            beta += slopes[:, at : at + len(own) + len(far)] @ x[at : at + len(own) + len(far)]
            for i, a in enumerate(own):
                for k, b in enumerate(far):
                    beta[place[a + b]] -= sign * one[i] * two[k]
            at, base = at + len(own) + len(far), base + len(known)
        return beta, slopes

    def fitted(self, gram: np.ndarray, lags: tuple[list[int], list[int]]) -> tuple[np.ndarray, float]:
        """The products' coefficients with the least sum of squares, and that sum; ``gram``: the lagged variables of both sides, then the series."""
        where = [{k: i for i, k in enumerate(known)} for known in lags]
        some = [i * len(lags[0]) + where[i][k] for i, (own, far, _) in enumerate(self.sides) for k in [*own, *far]]
        x, left = solved(gram, some)
        if self.linear:
            return self.design(lags, x)[0], left
        squares, with_series, total = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
        sse = lambda b: total - 2 * b @ with_series + b @ squares @ b
        beta, slopes = self.design(lags, x)
        best = sse(beta)
        for _ in range(STEPS):
            step = np.linalg.lstsq(slopes.T @ squares @ slopes, slopes.T @ (with_series - squares @ beta), rcond=1e-12)[0]
            for _ in range(30):
                beta, slopes_at = self.design(lags, x + step)
                now = sse(beta)
                if now <= best:
                    break
                step = step / 2
            else:
                break
            x, slopes, gain, best = x + step, slopes_at, best - now, now
            if gain <= 1e-12 * total:
                break
        return self.design(lags, x)[0], float(max(best, 0.0))


def candidates(most: tuple[int, int], period: int, seasonal: tuple[int, int]) -> list[Order]:
    """Every order up to ``most``, each with every number of seasonal lags up to ``seasonal``."""
    far = lambda m: [period * k for k in range(1, m + 1)]
    return [Order(list(range(1, p + 1)), list(range(1, q + 1)), far(a), far(b)) for p in range(most[0] + 1) for q in range(most[1] + 1) for a in range(seasonal[0] + 1) for b in range(seasonal[1] + 1)]


def arma_errors(rows: DataFrame, order: tuple[list[int], list[int]] | None, free: int = 0, most: tuple[int, int] = (4, 4), period: int = 1, seasonal: tuple[int, int] = (0, 0), long: int = LONG, given: tuple[list[float], list[float]] | None = None, size: int = ROWS, seasonal_lags: tuple[list[int], list[int]] = ((), ())) -> DataFrame:
    """(by, pos, e, p, q, seasonal_p, seasonal_q, ar, ma, aic) of series (by, pos, n, u); ``free`` counts the coefficients that u has cost already.

    ``order``: the lags of both parts, with ``seasonal_lags`` those of their seasonal factors, or None for a search up to the numbers of lags in ``most`` and, of
    multiples of ``period``, in ``seasonal``. An order of n parameters needs 3 * n + 10 rows; shorter series do without it. ``long``: the lags of the long
    autoregression; where seasonal errors are sought, the lags around ``SEASONS`` seasons are added. ``given``: the coefficients of both parts, each its own lags
    and then its seasonal ones, which aren't estimated then. ``ar`` and ``ma`` hold the products' coefficients from lag 1 on.
    """
    tried = candidates(most, period, seasonal) if order is None else [Order(*order, *seasonal_lags)]
    ar_lags, ma_lags = both = tuple(sorted({k for t in tried for k in t.lags(side)}) for side in (0, 1))
    deepest, q = max([0, *ar_lags, *ma_lags]), max([0, *ma_lags])
    ma_only = bool(ma_lags)
    seasons = sorted({k for t in tried for k in t.sides[1][1]})
    near = max([0, *(k for t in tried for k in t.sides[1][0])])
    long_lags = sorted({*range(1, long + 1), *(s * m + k for s in seasons[:1] for m in range(1, SEASONS + len(seasons)) for k in range(-near, near + 1) if s * m + k > 0)})
    long_lags_at, wide = list(range(len(long_lags))), len(long_lags)
    reach = max([0, *long_lags]) if ma_lags else 0
    size = max(size, reach + deepest)
    packed = written(blocks(rows, reach + deepest, size), "arma-blocks")

    def proxies(u: np.ndarray, a: np.ndarray) -> np.ndarray:
        return u - lagged(u, long_lags) @ a if ma_only else u

    @F.pandas_udf("array<double>")
    def gram_long(u: pd.Series, lead: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, at, m in zip(u, lead, n, strict=True):
            z = np.column_stack([lagged(x, long_lags), x])[at:]
            z[:, [i for i, k in enumerate(long_lags) if k > m // 4]] = 0.0
            out.append((z.T @ z).ravel())
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<double>")
    def solve_long(g: pd.Series) -> pd.Series:
        return pd.Series([solved(np.reshape(x, (wide + 1, wide + 1)), long_lags_at)[0] for x in g], dtype=object)

    @F.pandas_udf("array<double>")
    def gram(u: pd.Series, lead: pd.Series, a: pd.Series) -> pd.Series:
        out = []
        for x, at, coef in zip(u, lead, a, strict=True):
            z = np.column_stack([lagged(x, ar_lags), lagged(proxies(x, np.asarray(coef, float)), ma_lags), x])[at:]
            out.append((z.T @ z).ravel())
        return pd.Series(out, dtype=object)

    @F.pandas_udf("p int, q int, seasonal_p int, seasonal_q int, ar array<double>, ma array<double>")
    def solve(g: pd.Series, n: pd.Series) -> pd.DataFrame:
        out, width = [], len(ar_lags) + len(ma_lags) + 1
        for x, m in zip(g, n, strict=True):
            x, found = np.reshape(x, (width, width)), []
            for t in [*tried, Order([], [])]:
                if t.n == 0 or m >= 3 * t.n + 10:
                    b, left = t.fitted(x, both)
                    found.append((m * np.log(max(left / max(m, 1), 1e-300)) + 2 * t.n, t.n, t.sizes, b))
            sizes, b = (found[0] if order is not None else min(found, key=lambda t: t[:3]))[2:]
            out.append((*sizes, *dense(b)))
        return pd.DataFrame(out, columns=["p", "q", "seasonal_p", "seasonal_q", "ar", "ma"])

    def dense(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coefficients of lags 1, 2, .. of both sides."""
        ar, ma = np.zeros(max([0, *ar_lags])), np.zeros(q)
        ar[np.array(ar_lags, int) - 1] = b[: len(ar_lags)]
        ma[np.array(ma_lags, int) - 1] = b[len(ar_lags) :]
        return ar, ma if given else invertible(ma)

    def inputs(u, lead, ar):
        """c of the own rows of each block, in rows of equal length, and their lengths."""
        c = [(x - lagged(x, list(range(1, len(a) + 1))) @ np.asarray(a, float))[at:] for x, at, a in zip(u, lead, ar, strict=True)]
        length = np.array([len(x) for x in c])
        out = np.zeros((len(c), length.max(initial=0)))
        for i, x in enumerate(c):
            out[i, : len(x)] = x
        return out, length

    @F.pandas_udf("array<double>")
    def map_of(u: pd.Series, lead: pd.Series, ar: pd.Series, ma: pd.Series) -> pd.Series:
        """The affine map from the errors before a block to its last ones: q rows of q factors and a constant."""
        if not len(u):
            return pd.Series([], dtype=object)
        c, length = inputs(u, lead, ar)
        theta = np.array(ma.tolist(), float).reshape(len(u), q)
        sides = [recurrence(c, theta, np.zeros((len(u), q)))] + [recurrence(np.zeros_like(c), theta, np.repeat(np.eye(q)[j : j + 1], len(u), axis=0)) for j in range(q)]
        out = []
        for i, n in enumerate(length):
            last = lambda e, j: np.r_[e[i, :n][::-1][:q], np.eye(q)[j][: max(0, q - n)] if j >= 0 else np.zeros(max(0, q - n))]  # noqa: B023, E731
            out.append(np.column_stack([*(last(sides[1 + j], j) for j in range(q)), last(sides[0], -1)]).ravel())
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<array<double>>")
    def states(maps: pd.Series) -> pd.Series:
        """The state before each block, from the maps of a series' blocks in their order."""
        out = []
        for own in maps:
            now, before = np.zeros(q), []
            for m in own:
                before.append(now)
                m = np.reshape(np.asarray(m, float), (q, q + 1))
                now = m[:, :q] @ now + m[:, q]
            out.append(before)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<double>")
    def errors(u: pd.Series, lead: pd.Series, ar: pd.Series, ma: pd.Series, state: pd.Series) -> pd.Series:
        if not len(u):
            return pd.Series([], dtype=object)
        c, length = inputs(u, lead, ar)
        if q:
            c = recurrence(c, np.array(ma.tolist(), float).reshape(len(u), q), np.array([s if s is not None else np.zeros(q) for s in state], float).reshape(len(u), q))
        return pd.Series([x[:n] for x, n in zip(c, length, strict=True)], dtype=object)

    if ma_lags and not given:
        own = packed.join(summed(packed.select("by", gram_long("u", "lead", "n").alias("z")), "z").select("by", solve_long("g").alias("a")), "by")
    else:
        own = packed.withColumn("a", F.array().cast("array<double>"))
    names = ("p", "q", "seasonal_p", "seasonal_q")
    if given:
        own_parts = [v.tolist() for v in dense(tried[0].design(both, np.array([*given[0], *given[1]], float))[0])]
        packed = packed.select("*", *(F.lit(n).alias(c) for n, c in zip(tried[0].sizes, names, strict=True)), *(F.array(*map(F.lit, v)).cast("array<double>").alias(c) for c, v in zip(("ar", "ma"), own_parts, strict=True)))
    elif ar_lags or ma_lags:
        length = packed.groupBy("by").agg(F.max("n").alias("n"))
        found = summed(own.select("by", gram("u", "lead", "a").alias("z")), "z").join(length, "by").select("by", solve("g", "n").alias("f"))
        packed = packed.join(written(found, "arma-parts"), "by").select("*", "f.*").drop("f")
    else:
        none = F.array().cast("array<double>")
        packed = packed.select("*", *(F.lit(0).alias(c) for c in names), none.alias("ar"), none.alias("ma"))
    if q:
        maps = packed.select("by", "block", map_of("u", "lead", "ar", "ma").alias("m")).groupBy("by").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("r"))
        before = maps.select("by", F.explode(F.arrays_zip(F.col("r.block").alias("block"), states("r.m").alias("state"))).alias("s")).select("by", "s.block", "s.state")
        packed = packed.join(before, ["by", "block"])
    else:
        packed = packed.withColumn("state", F.array().cast("array<double>"))
    got = packed.select("by", "n", *names, "ar", "ma", F.slice("pos", F.col("lead").cast("int") + 1, F.size("pos")).alias("pos"), errors("u", "lead", "ar", "ma", "state").alias("e"))
    squares = got.groupBy("by").agg(F.sum(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)).alias("sse"))
    aic = F.col("n") * F.log(F.greatest(F.col("sse") / F.col("n"), F.lit(1e-300))) + 2 * (F.lit(free + 1) + F.col("p") + F.col("q") + F.col("seasonal_p") + F.col("seasonal_q"))
    got = got.join(squares, "by").withColumn("aic", aic)
    return got.select("by", *names, "ar", "ma", "aic", F.explode(F.arrays_zip("pos", "e")).alias("r")).select("by", "r.pos", "r.e", *names, "ar", "ma", "aic")
