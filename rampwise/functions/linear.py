"""Least squares by groups, in the JVM: Gram matrices as aggregates over pairs of columns, solved by Gauss-Jordan steps over arrays.

The plan has the same size for any number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A regressor of which less than this share of its variation isn't explained by those before it is left out (coefficient 0).
DEPENDENT = 1e-10


def eliminated(flat: Column, rows: int, width: int) -> Column:
    """``flat``, a matrix of ``rows`` rows and ``width`` columns, after Gauss-Jordan steps on its diagonal in order; rows without a pivot become 0."""
    at = F.sequence(F.lit(0), F.lit(rows * width - 1))

    def step(m: Column, k: Column) -> Column:
        pivot, first = F.get(m, k * width + k), F.get(flat, k * width + k)
        good = F.coalesce((pivot > F.lit(DEPENDENT) * first) & (first < float("inf")), F.lit(False))

        def entry(i: Column) -> Column:
            row, col = F.floor(i / width).cast("int"), (i % width).cast("int")
            along = F.get(m, k * width + col) / pivot
            return F.when(~good, F.when(row == k, F.lit(0.0)).otherwise(F.get(m, i))).when(row == k, along).otherwise(F.get(m, i) - F.get(m, row * width + k) * along)

        return F.transform(at, entry)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rows - 1)), flat, step)


def coefficients(rows: DataFrame, by: str, x: str, m: int, y: str, k: int, constant: bool) -> DataFrame:
    """(by, beta, mx, my): for each group the coefficients of each of the ``k`` values of ``y`` on the ``m`` values of ``x`` (one array after the other), and their means.

    With ``constant``, x and y are taken about their means; else the means are 0. x and y are arrays without missing values.
    """
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    if not m:
        means = rows.select(by, F.posexplode(y).alias("at", "v")).groupBy(by, "at").agg(F.avg("v").alias("v")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("at", "v")))["v"].alias("my"))
        return means.select(by, F.array().cast("array<double>").alias("beta"), F.array().cast("array<double>").alias("mx"), "my" if constant else zeros(k).alias("my"))
    pairs = [(i, j) for i in range(m) for j in range(i, m)] + [(i, m + j) for i in range(m) for j in range(k)]
    place = {p: n for n, p in enumerate(pairs)}
    z = F.concat(x, y)
    each = F.transform(F.sequence(F.lit(0), F.lit(len(pairs) - 1)), lambda t: F.struct(F.get("z", F.get(F.lit([i for i, _ in pairs]), t)).alias("a"), F.get("z", F.get(F.lit([j for _, j in pairs]), t)).alias("b")))
    long = rows.select(by, z.alias("z")).select(by, F.posexplode(each).alias("at", "p")).select(by, "at", "p.a", "p.b")
    varies = lambda c: F.min(c) < F.max(c)  # noqa: E731  the mean of equal numbers, put together from parts, may be off by a rounding error
    value = F.when(varies("a") & varies("b"), F.covar_pop("a", "b")).otherwise(F.lit(0.0)) if constant else F.avg(F.col("a") * F.col("b"))
    gram = long.groupBy(by, "at").agg(value.alias("v"), F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    gram = gram.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("at", "v", "ma", "mb"))).alias("g"))
    taken = lambda field, of: F.transform(F.lit(of), lambda t: F.get(F.col("g")[field], t))
    full = gram.select(by, "g", taken("v", [place[min(i, j), max(i, j)] for i in range(m) for j in range(m + k)]).alias("m"))
    solved = full.select(by, "g", eliminated(F.col("m"), m, m + k).alias("s"))
    beta = F.transform(F.lit([i * (m + k) + m + j for j in range(k) for i in range(m)]), lambda t: F.get("s", t))
    mx, my = taken("ma", [place[i, i] for i in range(m)]), taken("mb", [place[0, m + j] for j in range(k)])
    return solved.select(by, beta.alias("beta"), (mx if constant else zeros(m)).alias("mx"), (my if constant else zeros(k)).alias("my"))


def fitted(x: str, m: int, k: int) -> Column:
    """The ``k`` fitted values of a row with the columns of ``coefficients``."""
    centred = F.zip_with(x, "mx", lambda a, b: a - b)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get("my", j) + (F.aggregate(F.zip_with(centred, F.slice("beta", j * m + 1, F.lit(m)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) if m else F.lit(0.0)))
