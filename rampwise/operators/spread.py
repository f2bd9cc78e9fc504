"""Positions, earlier rows, running sums and medians of very long series, in two passes over ranges of rows.

Rows are sorted by range over the cluster and numbered within each range; what comes before a range is known from one row for each
series and range. No task gets a whole series, and nothing but these few rows is looked at in the order of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.sources.scratch import written

#: Names that these functions add: the range, the row's number, the position in the series (from 1) and the size of the series.
PART, ROW, POS, SIZE = "_part", "_row", "_pos", "_size"


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df``, written once, with ``_part``, ``_row``, ``_pos`` and ``_size``: rows of ``key`` in the order of the columns ``order``.

    Rows of equal order are cut apart by a hash of all their columns; only rows that are equal in every column stay together.
    """
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)) if df.columns else F.lit(0)
    own = df.withColumn("_tie", tie)
    own = own.repartitionByRange(key, *order, "_tie").sortWithinPartitions(key, *order, "_tie").drop("_tie")
    own = written(own.withColumn(ROW, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(ROW, 33)), "ranges")
    ranges = own.groupBy(key, PART).agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_n"))
    series, before = Window.partitionBy(key), Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(key, PART, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(series).alias(SIZE))
    got = own.join(ranges, [key, PART])
    return got.withColumn(POS, F.col("_before") + F.col(ROW) - F.col("_first") + 1).drop("_first", "_before")


def running_sums(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """A numbered table with the running sum of each column of ``sums`` over its series, up to and with each row."""
    own = df.select("*", *(v.alias(c) for c, v in sums.items()))
    totals = own.groupBy(key, PART).agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)))
    before = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, PART, *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    local = Window.partitionBy(key, PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    got = own.select(*df.columns, *(F.sum(c).over(local).alias(c) for c in sums)).join(totals, [key, PART])
    return got.select(*df.columns, *((F.col(c) + F.col(f"_b{i}")).alias(c) for i, c in enumerate(sums)))


def with_before(df: DataFrame, key: str, pos: str, lags: list[int], values: list[str]) -> DataFrame:
    """The rows of ``df`` that have rows of their series ``lags`` (positive) positions before, with ``_before``: for each lag in ascending order a struct of those rows' ``values``.

    A row is sent to its own position and, with no more than these values, to the positions that ask for it: a group is one position, never a series.
    """
    sent = df.select(key, pos, F.explode(F.array(*(F.lit(k) for k in [0, *lags]))).alias("_lag"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_all"))
    sent = sent.select(key, (F.col(pos) + F.col("_lag")).alias("_at"), F.when(F.col("_lag") == 0, F.col("_all")).alias("_row"), F.when(F.col("_lag") > 0, F.struct("_lag", *(F.col("_all")[v].alias(v) for v in values))).alias("_earlier"))
    got = sent.groupBy(key, "_at").agg(F.first("_row", ignorenulls=True).alias("_row"), F.sort_array(F.collect_list("_earlier")).alias("_before"))
    return got.filter(F.col("_row").isNotNull() & (F.size("_before") == len(lags))).select("_row.*", "_before")


#: Rows of a group beyond which its median is sent to all tasks; smaller groups meet theirs in an exchange.
LARGE = 200_000


def medians(df: DataFrame, key: str, value: str, to: str = "median") -> DataFrame:
    """(key, ``to``, ``_all``): the exact median of each group's values that aren't NULL, and their number, from the running counts of its distinct values in sorted ranges.

    Only ranges that hold a middle place are looked at row by row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    own = numbered(counted, key, [value]).select(key, PART, ROW, value, "_n")
    series = Window.partitionBy(key)
    upto = F.sum("_part_n").over(series.orderBy(PART).rowsBetween(Window.unboundedPreceding, 0))
    totals = own.groupBy(key, PART).agg(F.sum("_n").alias("_part_n")).select(key, PART, (upto - F.col("_part_n")).alias("_b"), upto.alias("_e"), F.sum("_part_n").over(series).alias("_all"))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = totals.filter((F.col("_e") >= low) & (F.col("_b") < high))
    own = own.join(middle, [key, PART])
    own = own.withColumn("_upto", F.col("_b") + F.sum("_n").over(Window.partitionBy(key, PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)))
    holds = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") < place) & (F.col("_upto") >= place), F.col(value)))
    return own.groupBy(key).agg(((holds(low) + holds(high)) / 2).alias(to), F.max("_all").alias("_all"))


def with_medians(df: DataFrame, key: str, found: DataFrame, to: str) -> DataFrame:
    """``df`` with each group's ``to`` of ``found`` (``medians``; NULL for others). Large groups, which are few, get theirs without being brought together; the rest by an exchange that holds none of their rows."""
    found = written(found, "medians")
    large = found.filter(F.col("_all") > LARGE).select(key, F.col(to).alias("_large"))
    rest = found.filter(F.col("_all") <= LARGE).select(key, to)
    got = df.join(F.broadcast(large), key, "left")
    if rest.isEmpty():
        return got.withColumnRenamed("_large", to)
    here = got.filter(F.col("_large").isNotNull()).withColumnRenamed("_large", to)
    return here.unionByName(got.filter(F.col("_large").isNull()).drop("_large").join(rest, key, "left"))


def robust_z(df: DataFrame, key: str, value: str, to: str = "z") -> DataFrame:
    """``df`` with (x - median) / MAD, as ``functions.numeric.robust_z``, for groups of any size: two sorts by range, no group in one task."""
    off = with_medians(df, key, medians(df, key, value, "_median"), "_median").withColumn("_off", F.col(value) - F.col("_median")).drop("_median")
    off = written(off, "off-median")
    off = with_medians(off, key, medians(off.select(key, F.abs("_off").alias("_abs")), key, "_abs", "_mad"), "_mad")
    return off.withColumn(to, F.col("_off") / F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.lit(1e-8))).drop("_off", "_mad")
