"""The real-time detector over a stream, with state for each series.

A stream can't give what needs the whole series: there is no offline score, and no row of a series comes before its burn-in block is full. The
rows of that block, which see all of it, are emitted then where ``burn_in_rows`` is set.

With ``delay``, points of a series are taken in the order of their event time: each waits in the state until the watermark has passed it, and points
behind the watermark are dropped by the engine. Without it, points are ordered within each micro-batch, and one that comes later than a
newer one's batch is taken as the next.

The state of a series is a list of values to which each micro-batch appends (it is never rewritten), the points that wait, and those of an unfinished burn-in
block. Scores are computed once for each point, from running sums that are built once for each micro-batch. The state needs
Spark's RocksDB store, which is set for the session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from rampwise.operators.prefixes import first_scores, last_score, running
from rampwise.operators.series import named, require, unclashing

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULTS = ("time_ind", "signal", "detected_value_rt", "flag")


def prefix_score(sums: np.ndarray, lowwl: int, highwl, mad_k: float, direction: str, smooth_k: int) -> float:
    """The smoothed score of the last point of a prefix from its running sums (rows s, t, c; a column for each end)."""
    return last_score(sums, sums.shape[1] - 1, lowwl, highwl, mad_k, direction, smooth_k)


class Detector(StatefulProcessor):
    """Scores of the points of a series as they come."""

    def __init__(self, keys: list[str], stamps: bool, waits: bool, burn_in: int, burn_in_rows: bool, threshold: float, options: tuple):
        self.keys, self.stamps, self.waits, self.burn_in, self.burn_in_rows, self.threshold, self.options = keys, stamps, waits, burn_in, burn_in_rows, threshold, options

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "ys binary")
        self.pending = handle.getListState("pending", "at bigint, y double")
        self.block = handle.getListState("block", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        frames = [f for f in rows if len(f)]
        pdf = pd.concat(frames) if frames else pd.DataFrame({"at": [], "y": []})
        at = pdf["at"].to_numpy("datetime64[us]").astype(np.int64) if self.stamps else pdf["at"].to_numpy(np.int64)
        y = pdf["y"].to_numpy(float)
        if not self.waits:
            order = np.argsort(at, kind="stable")
            yield self.scored(key, at[order], y[order])
            return
        self.pending.appendList([(int(a), None if np.isnan(v) else float(v)) for a, v in zip(at, y, strict=True)])
        yield self.released(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.released(key, timerValues.getCurrentWatermarkInMs())

    def released(self, key, watermark: int) -> pd.DataFrame:
        """The waiting points up to the watermark, in their order."""
        waiting = sorted(((a, np.nan if v is None else v) for a, v in self.pending.get()), key=lambda p: p[0])
        ready = [p for p in waiting if p[0] <= watermark * 1000]
        rest = waiting[len(ready) :]
        if ready:
            self.pending.put([(a, None if np.isnan(v) else v) for a, v in rest]) if rest else self.pending.clear()
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        return self.scored(key, np.array([a for a, _ in ready], np.int64), np.array([v for _, v in ready], float))

    def scored(self, key, at: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        """Rows of new points, which come after all points of the state."""
        known = np.concatenate([np.zeros(0), *(np.frombuffer(v[0], float) for v in self.values.get())])
        n, found = len(known), ([], [], [])
        if len(y):
            self.values.appendValue((y.tobytes(),))
            both = np.r_[known, y]
            some = np.flatnonzero(np.isfinite(both))
            sums = running(both - (both[some[0]] if len(some) else 0.0))  # slopes don't depend on the level
            low, highwl, mad_k, direction, smooth = self.options
            if n < self.burn_in and self.burn_in_rows:
                first = np.r_[np.array([v[0] for v in self.block.get()], np.int64), at[: self.burn_in - n]]
                if len(first) == self.burn_in:
                    self.block.clear()
                    found = tuple([list(first), list(both[: self.burn_in]), list(first_scores(sums, self.burn_in, low, highwl, mad_k, direction, smooth))])
                else:
                    self.block.put([(int(a),) for a in first])
            for i in range(max(n, self.burn_in), len(both)):
                for out, v in zip(found, (at[i - n], both[i], last_score(sums, i + 1, low, highwl, mad_k, direction, smooth)), strict=True):
                    out.append(v)
        times = np.array(found[0], np.int64)
        out = pd.DataFrame({k: pd.Series([v] * len(times), dtype=object) for k, v in zip(self.keys, key, strict=True)})
        values = pd.Series(found[1], dtype=float)
        return out.assign(time_ind=times.astype("datetime64[us]") if self.stamps else times, signal=values.where(np.isfinite(values)), detected_value_rt=pd.Series(found[2], dtype=float), flag=pd.Series([v >= self.threshold for v in found[2]], dtype=bool))


def detect_stream(stream: DataFrame, key: str | list[str], time: str, value: str, lowwl: int = 5, highwl="auto", mad_k: float = 3.0, direction: str = "positive", burn_in: int = 100, smooth_k: int = 30, threshold: float = 0.02, delay: str | None = None, burn_in_rows: bool = False) -> DataFrame:
    """(keys, time_ind, signal, detected_value_rt, flag) for every point after the first ``burn_in`` of its series, and for these too with ``burn_in_rows``.

    ``time`` is a timestamp or a whole number, a timestamp with ``delay``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require(stream, *keys, time, value)
    unclashing(keys, *RESULTS, "at", "y")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    stamps = kinds[time] in ("timestamp", "timestamp_ntz")
    if not stamps and (kinds[time] not in ("bigint", "int", "smallint", "tinyint") or delay):
        raise ValueError("time is a timestamp, or a whole number where there is no delay")
    if stream.sparkSession.conf.get(STORE) != ROCKSDB:
        stream.sparkSession.conf.set(STORE, ROCKSDB)
    own = stream.select(*(named(k) for k in keys), named(time).alias("at"), named(value).cast("double").alias("y"))
    own = own.withWatermark("at", delay) if delay else own
    quoted = ", ".join(f"`{k.replace('`', '``')}` {kinds[k]}" for k in keys)
    out = f"{quoted}, time_ind {kinds[time]}, signal double, detected_value_rt double, flag boolean"
    options = (max(2, int(lowwl)), highwl, float(mad_k), direction, max(1, int(smooth_k)))
    detector = Detector(keys, stamps, bool(delay), burn_in, burn_in_rows, threshold, options)
    return own.groupBy(*(named(k) for k in keys)).transformWithStateInPandas(statefulProcessor=detector, outputStructType=out, outputMode="append", timeMode="eventTime" if delay else "none")
