"""Signals (time_ind, signal): raw columns, top eigenvalues, residuals, and top eigenvalues of residuals.

Columns may have any names; keys may not be named time_ind or signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.functions.numeric import to_double
from rampwise.operators.arimax import arimax_residuals, arimax_residuals_df
from rampwise.operators.eigen import roll_svd
from rampwise.operators.series import named, require, resolve, unclashing


def signal_of(df: DataFrame, time: str, signal, keys: list[str] | None) -> DataFrame:
    """(keys, time_ind, signal) from the columns of ``df``."""
    unclashing(keys, "time_ind", "signal")
    return df.select(*(named(k) for k in keys or []), named(time).alias("time_ind"), signal.alias("signal"))


def build_signal_raw(data: DataFrame, time: str, col: str, keys: list[str] | None = None) -> DataFrame:
    require(data, time, col)
    return signal_of(data, time, to_double(col, {f.name: f.dataType for f in data.schema}[col]), keys)


def build_signal_svd(data: DataFrame, time: str, x_cols, window: int, scale_: bool = True, keys: list[str] | None = None, **options) -> DataFrame:
    """The largest eigenvalue of each window; NULL where it is skipped."""
    return signal_of(roll_svd(data, time, x_cols, window, scale_=scale_, k=1, keys=keys, **options), "t_rep", F.get("d", F.lit(0)), keys)


def build_signal_arimax_resid(data: DataFrame, time: str, y_col, xreg_cols=None, keys: list[str] | None = None, **options) -> DataFrame:
    """The residuals on the used rows."""
    if len(resolve(data, y_col)) != 1:
        raise ValueError("y_col is one column")
    return signal_of(arimax_residuals(data, time, y_col, xreg_cols, keys=keys, **options), "time", F.col("residual"), keys)


def arimax_then_roll_svd(data: DataFrame, time: str, y_cols, xreg_cols, window: int, order=None, keys: list[str] | None = None, fit_options: dict | None = None, **options) -> DataFrame:
    """``roll_svd`` over the residuals of every y column; ``fit_options`` go to ``arimax_residuals``, other options to ``roll_svd``."""
    own = arimax_residuals_df(data, time, y_cols, xreg_cols, order, keys, **(fit_options or {}))
    return roll_svd(own, "time", resolve(data, y_cols), window, keys=keys, **options)


def build_signal_arimax_svd(data: DataFrame, time: str, y_cols, xreg_cols, window: int, scale_: bool = True, keys: list[str] | None = None, **options) -> DataFrame:
    got = arimax_then_roll_svd(data, time, y_cols, xreg_cols, window, scale_=scale_, k=1, keys=keys, **options)
    return signal_of(got, "t_rep", F.get("d", F.lit(0)), keys)
