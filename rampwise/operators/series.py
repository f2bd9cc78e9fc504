"""Positioned series, column selection and missing-value policies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.functions.numeric import finite, to_double
from rampwise.operators.spread import POS, SIZE, numbered

POLICIES = ("omit_rows", "impute_mean", "pairwise_complete")


def resolve(df: DataFrame, x_cols) -> list[str]:
    """Names of feature columns: a list of names, one name, or (a string with ``|``) a pattern searched in all names."""
    if isinstance(x_cols, str):
        names = [c for c in df.columns if re.search(x_cols, c)] if "|" in x_cols else [x_cols]
    elif isinstance(x_cols, (list, tuple)):
        names = list(x_cols)
    else:
        raise ValueError("x_cols is a name, a pattern or a list of names")
    if not names:
        raise ValueError("no column is selected")
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"no such columns: {missing}")
    if len(set(names)) < len(names):
        raise TypeError("a column is selected twice")
    return names


def named(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def series_key(keys: list[str] | None) -> Column:
    """One column that names a series, ``key``: a struct of the key columns. Structs are equal where their NULLs are, so that series with NULL keys join and group like others."""
    return F.struct(*(named(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("key") if keys else F.struct(F.lit(0).alias("k0")).alias("key")


def key_columns(keys: list[str] | None) -> list[Column]:
    """The key columns, by their own names, from ``key``."""
    return [F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys or [])]


def unclashing(keys: list[str] | None, *results: str) -> None:
    """An error where a key has the name of a result column."""
    if both := sorted({k.lower() for k in keys or []} & set(results)):
        raise ValueError(f"keys have names of result columns: {both}")


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name}")


def extract_x(df: DataFrame, x_cols, keep: tuple[str, ...] = ()) -> DataFrame:
    """The selected columns as doubles, after the columns of ``keep``."""
    names, kinds = resolve(df, x_cols), {f.name: f.dataType for f in df.schema}
    return df.select(*(named(c) for c in keep), *(to_double(c, kinds[c]).alias(c) for c in names))


def positioned(df: DataFrame, order_by: list[str], keys: list[str] | None = None, spread: bool = False) -> DataFrame:
    """``df`` with ``pos`` (from 1) and ``n`` in each series; ``df`` has no columns of these names.

    One series is one partition of the window; many keys spread. With ``spread``, for very long series, rows are sorted by ranges and written once instead.
    """
    if taken := {"pos", "n"} & {c.lower() for c in df.columns}:
        raise ValueError(f"positions would overwrite the columns {sorted(taken)}")
    if spread:
        own = df.select(series_key(keys).alias("_series"), F.struct(*map(named, df.columns)).alias("_values"), *(named(c).alias(f"_o{i}") for i, c in enumerate(order_by)))
        own = numbered(own, "_series", [f"_o{i}" for i in range(len(order_by))])
        return own.select(*(F.col("_values").getField(c).alias(c) for c in df.columns), F.col(POS).alias("pos"), F.col(SIZE).alias("n"))
    series = Window.partitionBy(*(map(named, keys) if keys else [F.lit(0)]))
    return df.withColumn("pos", F.row_number().over(series.orderBy(*map(named, order_by))).cast("long")).withColumn("n", F.count(F.lit(1)).over(series))


def na_handle(df: DataFrame, cols: list[str], method: str = "omit_rows", keys: list[str] | None = None) -> DataFrame:
    """Rows without missing values, missing values replaced by the mean of their column (if it has two values), or ``df`` as it is."""
    if method not in POLICIES:
        raise ValueError(f"na_action is one of {POLICIES}")
    if method == "omit_rows":
        return df.filter(present(cols))
    if method == "impute_mean":
        own = Window.partitionBy(*(map(named, keys) if keys else [F.lit(0)]))
        mean = lambda c: F.when(c.isNull() & (F.count(c).over(own) > 1), F.avg(c).over(own)).otherwise(c)
        return df.select(*(mean(named(c)).alias(c) if c in cols else named(c) for c in df.columns))
    return df


def present(cols: list[str]) -> Column:
    """A condition: no column is NULL."""
    out = F.lit(True)
    for c in cols:
        out = out & named(c).isNotNull()
    return out


def all_finite(cols: list[str]):
    """A condition: every column is finite."""
    out = F.lit(True)
    for c in cols:
        out = out & finite(named(c))
    return out
