"""The CSV sink, the frame of the overlay plot, and the plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampwise.functions.numeric import finite, no_nan


def write_rt_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Writes ``df`` as CSV with a header to a folder that is overwritten; NaN and NULL are empty. Booleans are ``true`` and ``false``."""
    own = df.select(*(no_nan(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))
    own = own.coalesce(1) if single_file else own
    own.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path


def overlay_frame(df: DataFrame, time_col: str = "time_ind", score_col: str = "detected_value_rt", signal_col: str = "signal", scale_factor: float | None = None) -> DataFrame:
    """(x, score, signal, scaled_signal, alpha): the signal brought to the span of the score."""
    own = df.select(F.col(time_col).alias("x"), no_nan(F.col(score_col).cast("double")).alias("score"), no_nan(F.col(signal_col).cast("double")).alias("signal"))
    if scale_factor is None:
        span = own.agg((F.max("score") - F.min("score")).alias("a"), (F.max("signal") - F.min("signal")).alias("b"))
        usable = finite(F.col("a")) & finite(F.col("b")) & (F.col("a") != 0) & (F.col("b") != 0)
        alpha = span.select(F.when(usable, F.col("a") / F.col("b")).otherwise(F.lit(1.0)).alias("alpha"))
        own = own.crossJoin(F.broadcast(alpha))  # one row
    else:
        usable = scale_factor == scale_factor and abs(scale_factor) not in (0, float("inf"))
        own = own.withColumn("alpha", F.lit(float(scale_factor) if usable else 1.0))
    return own.select("x", "score", "signal", (F.col("signal") * F.col("alpha")).alias("scaled_signal"), "alpha")


def first_detection(df: DataFrame, col: str = "first_detection_time") -> DataFrame:
    """One row with the first detection time that isn't NULL, if there is one."""
    return df.filter(F.col(col).isNotNull()).agg(F.min(col).alias(col))


def overlay_pixels(df: DataFrame, width: int = 2700, **options) -> DataFrame:
    """(pixel, n, x_first, x_last, and first, lo, hi, last of score and of scaled_signal, alpha): ``overlay_frame`` cut to ``width`` columns of pixels.

    A line drawn through the first, least, largest and last value of each column of pixels has the same pixels as the line through all points. Numbers and
    times are cut into equal spans between the least and the largest x, other types by rank. Rows without x are left out.
    """
    own = overlay_frame(df, **options).filter("x is not null")
    kind = dict(own.dtypes)["x"]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        own = own.withColumn("_at", F.unix_micros(F.col("x").cast("timestamp")).cast("double"))
    elif kind in ("string", "boolean"):
        own = own.join(own.select("x").distinct().withColumn("_at", F.row_number().over(Window.orderBy("x")).cast("double")), "x")
    else:
        own = own.withColumn("_at", F.col("x").cast("double"))
    span = own.agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    own = own.crossJoin(F.broadcast(span))  # one row
    place = F.floor((F.col("_at") - F.col("_from")) / F.nullif(F.col("_to") - F.col("_from"), F.lit(0.0)) * width)
    own = own.withColumn("pixel", F.least(F.coalesce(place, F.lit(0)), F.lit(width - 1)).cast("long"))
    both = []
    for c in ("score", "scaled_signal"):
        at = F.when(F.col(c).isNotNull(), F.col("_at"))
        both += [F.min_by(c, at).alias(f"{c}_first"), F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.max_by(c, at).alias(f"{c}_last")]
    return own.groupBy("pixel").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_first"), F.max("x").alias("x_last"), *both, F.first("alpha").alias("alpha"))


def tick_labels(ticks, alpha: float) -> list[str]:
    """Labels of the right axis: places of the left one in the signal's own units, three significant digits."""
    return [f"{t / alpha:.3g}" for t in ticks]


def line_points(rows: list, column: str) -> tuple[list, list]:
    """The points of a line through rows of ``overlay_pixels``; missing values are left out."""
    x, y = [], []
    for r in rows:
        for at, part in ((r["x_first"], "first"), (r["x_first"], "lo"), (r["x_last"], "hi"), (r["x_last"], "last")):
            if r[f"{column}_{part}"] is not None:
                x.append(at)
                y.append(r[f"{column}_{part}"])
    return x, y


def plot_detection_overlay(df: DataFrame, title: str = "Detection overlay", threshold: float | None = None, save_path: str | None = None, first_det_col: str = "first_detection_time", score_label: str = "Real-Time Detected Value", signal_label: str = "Signal", x_label: str = "Index", score_color: str = "red", signal_color: str = "black", width: float = 9, height: float = 7.5, dpi: int = 300, **options):
    """Draws the overlay with matplotlib, where it is installed, on the driver, which gets a row for each column of pixels at most; (figure, left axis, right axis)."""
    import matplotlib.pyplot as plt

    rows = overlay_pixels(df, max(1, round(width * dpi)), **options).orderBy("pixel").collect()
    alpha = rows[0]["alpha"] if rows else 1.0
    fig, ax = plt.subplots(figsize=(width, height), dpi=dpi)
    lines = [ax.plot(*line_points(rows, c), color=color, linewidth=w, label=label)[0] for c, color, w, label in (("score", score_color, 1.2, score_label), ("scaled_signal", signal_color, 1.0, signal_label))]
    if threshold is not None and abs(threshold) < float("inf"):
        ax.axhline(threshold, linestyle="--", color=score_color, linewidth=0.9)
    if first_det_col in df.columns and (at := first_detection(df, first_det_col).head()[0]) is not None:
        ax.axvline(at, linestyle=":", color="steelblue")
    ax.set(title=title, xlabel=x_label)
    ax.set_ylabel(score_label, color=score_color)
    twin = ax.twinx()
    twin.set_ylabel(signal_label, color=signal_color)
    twin.set_ylim(ax.get_ylim())
    twin.set_yticks(ax.get_yticks(), tick_labels(ax.get_yticks(), alpha))
    ax.legend(handles=lines, loc="upper right")
    if save_path:
        fig.savefig(save_path, dpi=dpi, bbox_inches="tight")
    return fig, ax, twin
