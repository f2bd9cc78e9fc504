"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(x: Column) -> Column:
    """True where x is neither missing nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def no_nan(x: Column) -> Column:
    """NaN as NULL: the engine's only missing marker."""
    return F.when(~F.isnan(x), x)


def to_double(name: str, kind: T.DataType) -> Column:
    """A column as a double; what isn't a number becomes NULL. Dates and times are rejected."""
    x = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{name}: a date or time can't be a feature")
    if isinstance(kind, T.StringType):
        x = F.when(~x.rlike("[0-9.][dDfF]\\s*$"), x.try_cast("double"))  # a suffix of Java's literals isn't part of a number
    return no_nan(x.cast("double"))


def robust_z(df: DataFrame, x: str, by: list[str], to: str = "z") -> DataFrame:
    """``df`` with ``to``: (x - median) / MAD within each group, exact and without the factor 1.4826; a MAD of zero counts as 1e-8. One exchange.

    A group is one partition of a window; ``operators.spread`` has the form for groups of any size.
    """
    off, mad = (next(n for k in range(len(df.columns) + 1) if (n := f"_{c}{k}").lower() not in {d.lower() for d in df.columns} | {to.lower()}) for c in ("off", "mad"))
    over = Window.partitionBy(*by)
    got = df.withColumn(off, F.col(x) - F.median(x).over(over)).withColumn(mad, F.median(F.abs(off)).over(over))
    return got.withColumn(to, F.col(off) / F.when(F.col(mad) > 0, F.col(mad)).otherwise(F.lit(1e-8))).drop(off, mad)
