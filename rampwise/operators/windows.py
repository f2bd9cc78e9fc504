"""Rolling and expanding windows as tables and as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampwise.operators.series import key_columns, named, series_key, unclashing

ALIGN, TYPES = ("end", "start", "center"), ("rolling", "expanding")


def checked(window: int, step: int, align: str, type: str) -> tuple[str, str]:
    if window < 1:
        raise ValueError("window is less than 1")
    if step < 1:
        raise ValueError("step is less than 1")
    align, type = align.lower(), type.lower()
    if align not in ALIGN or type not in TYPES:
        raise ValueError(f"align is one of {ALIGN}, type one of {TYPES}")
    return align, type


def roll_windows(series: DataFrame, time: str, window: int, step: int = 1, align: str = "end", type: str = "rolling", keys: list[str] | None = None) -> DataFrame:
    """(keys, window_id, start, end, t_rep, idx) of a positioned series; one short window where it has fewer rows than ``window``. ``idx`` costs nothing where it isn't selected."""
    align, type = checked(window, step, align, type)
    unclashing(keys, "window_id", "start", "end", "t_rep", "idx")
    series = series.select(series_key(keys), named(time).alias("time"), "pos", "n")
    own = bounded(ends(series, window, step).select("key", "window_id", "pos"), window, type, "pos").select("key", "window_id", "start", F.col("pos").alias("end"))
    at = {"end": F.col("end"), "start": F.col("start"), "center": F.floor((F.col("start") + F.col("end")) / 2)}[align]
    times = series.select("key", F.col("pos").alias("at"), F.col("time").alias("t_rep"))
    return own.withColumn("at", at.cast("long")).join(times, ["key", "at"]).select(*key_columns(keys), "window_id", "start", "end", "t_rep", F.sequence("start", "end").alias("idx"))


def ends(series: DataFrame, window: int, step: int) -> DataFrame:
    """The rows at which a window ends, with its ``window_id``."""
    full = (F.col("pos") >= window) & ((F.col("pos") - window) % step == 0)
    short = (F.col("n") < window) & (F.col("pos") == F.col("n"))
    return series.filter(full | short).withColumn("window_id", window_number(window, step))


def window_number(window: int, step: int):
    """The ``window_id`` of the window that ends at ``pos`` in a series of ``n`` rows."""
    number = F.when(F.col("n") < window, F.lit(1)).otherwise(F.floor((F.col("pos") - window) / step) + 1)
    return number.cast("long")


def bounded(df: DataFrame, window: int, type: str, end: str) -> DataFrame:
    start = F.lit(1) if type == "expanding" else F.greatest(F.lit(1), F.col(end) - window + 1)
    return df.withColumn("start", start.cast("long"))


def frame(window: int, type: str, keys: list[str] | None = None):
    """The frame of rows that ends at each row."""
    own = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("pos")
    return own.rowsBetween(Window.unboundedPreceding if type == "expanding" else 1 - window, 0)
