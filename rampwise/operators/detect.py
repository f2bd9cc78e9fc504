"""Multi-scale slope voting, offline and prefix by prefix, in its prefix-sum form.

Whole runs are relational, as told below; growing prefixes go through the kernel of ``prefixes``.

For every window length w of a run over the first m points, the points fall into floor(m / w) blocks; a block's least-squares
slope comes from running sums at its two ends, so a block costs the same at any length. Blocks vote by the robust z-score
of their slope among the run's blocks of that length. Only blocks are rows: a vote is a step up where its block begins and
a step down where it ends, and running sums over a series' points add the steps up.

A series is named by a struct of its key columns, so that NULL keys are keys like others; the caller's columns are carried along
in a struct and may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampwise.functions.numeric import finite, no_nan, robust_z
from rampwise.operators.prefixes import prefix_scores
from rampwise.operators.series import key_columns, named, series_key, unclashing
from rampwise.operators.spread import PART, POS, ROW, SIZE, numbered, running_sums
from rampwise.operators.spread import robust_z as spread_robust_z
from rampwise.sources.scratch import written

#: A z-score within this relative distance of the limit is a tie but for rounding errors: differences of running sums can't tell its side.
TIE = 1e-9
DIRECTIONS = ("positive", "negative", "both")


def _highest(m, lowwl: int, highwl):
    """The largest window length of a run over m points."""
    auto = isinstance(highwl, str) and highwl.lower() == "auto"
    high = F.greatest(F.lit(5), F.floor(m / 3)) if auto else F.least(F.lit(int(highwl)), m)
    return F.greatest(high, F.lit(lowwl)).cast("long")


KEY = ["key"]


def _sums(series: DataFrame) -> DataFrame:
    """(key, at, s, t, c): sums of y and i * y and the number of missing values before position ``at`` (from 0), y centred."""
    own = Window.partitionBy("key")
    before = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    y = F.when(finite(F.col("y")), F.col("y"))
    got = series.select("key", "i", F.coalesce(y - F.avg(y).over(own), F.lit(0.0)).alias("y"), y.isNull().cast("long").alias("missing"))
    got = got.select("key", "i", F.sum("y").over(before).alias("s"), F.sum(F.col("i") * F.col("y")).over(before).alias("t"), F.sum("missing").over(before).alias("c"))
    row = lambda at, s, t, c: F.struct(at.cast("long").alias("at"), s.alias("s"), t.alias("t"), c.cast("long").alias("c"))
    after = row(F.col("i") + 1, F.col("s"), F.col("t"), F.col("c"))
    zero = row(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0))
    return got.select("key", F.explode(F.when(F.col("i") == 0, F.array(zero, after)).otherwise(F.array(after))).alias("row")).select("key", "row.*")


def _spread_sums(series: DataFrame) -> DataFrame:
    """The same from a numbered series, in two passes over its ranges."""
    y = F.when(finite(F.col("y")), F.col("y"))
    mean = series.groupBy("key").agg(F.avg(y).alias("mean"))
    own = series.join(mean, "key").select("key", PART, ROW, "i", F.coalesce(y - F.col("mean"), F.lit(0.0)).alias("y"), y.isNull().cast("long").alias("missing"))
    got = running_sums(own, "key", {"s": F.col("y"), "t": F.col("i") * F.col("y"), "c": F.col("missing")}).select("key", (F.col("i") + 1).alias("at"), "s", "t", "c")
    return got.unionByName(series.select("key").distinct().select("key", F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("c")))


def _direct(runs: DataFrame, points: DataFrame) -> DataFrame:
    """(key, m, w, st, z) of all blocks of ``runs`` (key, m, w): slopes as their definition has them, each block's own sum in the order of its points (key, i, y)."""
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / F.col("w")) - 1))
    at = runs.withColumn("b", b).withColumn("st", F.floor((F.col("m") % F.col("w")) / 2) + F.col("w") * F.col("b")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))
    own = at.withColumn("i", F.col("st") + F.col("j")).join(points.select(*KEY, "i", F.when(finite(F.col("y")), F.col("y")).alias("y")), [*KEY, "i"])
    w = F.col("w").cast("double")
    own = own.groupBy(*KEY, "m", "w", "st").agg(F.sort_array(F.collect_list(F.struct("j", "y"))).alias("p")).filter(F.size("p") == F.col("w"))
    total = F.aggregate("p", F.lit(0.0), lambda s, p: s + (p["j"] + 1 - (w + 1) / 2) * p["y"])
    own = own.select(*KEY, "m", "w", "st", (total / (w * (w * w - 1) / 12)).alias("slope")).filter("slope is not null")
    return robust_z(own, "slope", [*KEY, "m", "w"]).select(*KEY, "m", "w", "st", "z")


def block_votes(sums: DataFrame, runs: DataFrame, mad_k: float, direction: str, spread: bool = False, points: DataFrame | None = None) -> DataFrame:
    """(key, m, w, st, vote) of the blocks that vote, for runs (key, m, lo, hi).

    Runs with a z-score at the very limit are computed once more from their ``points``, where these are given.
    """
    keys = KEY
    lengths = runs.filter("m >= 3").select(*keys, "m", F.explode(F.sequence("lo", F.greatest("lo", F.least("hi", "m")))).alias("w")).filter("w <= m")
    b = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / F.col("w")) - 1))
    blocks = lengths.select(*keys, "m", "w", b.alias("b")).select(*keys, "m", "w", (F.floor((F.col("m") % F.col("w")) / 2) + F.col("w") * F.col("b")).alias("st"))
    ends = lambda n: sums.select(*keys, *(F.col(c).alias(f"{c}{n}") for c in ("at", "s", "t", "c")))
    own = blocks.withColumn("at0", F.col("st")).join(ends(0), [*keys, "at0"]).withColumn("at1", F.col("st") + F.col("w")).join(ends(1), [*keys, "at1"])
    w = F.col("w").cast("double")
    slope = ((F.col("t1") - F.col("t0")) - (F.col("st") + (w - 1) / 2) * (F.col("s1") - F.col("s0"))) / (w * (w * w - 1) / 12)
    own = own.select(*keys, "m", "w", "st", F.when(F.col("c1") == F.col("c0"), slope).alias("slope")).filter("slope is not null")
    if spread:
        z = spread_robust_z(written(own.select(F.struct(*keys, "m", "w").alias("run"), "st", "slope"), "slopes"), "run", "slope").select("run.*", "st", "z")
    else:
        z = robust_z(own, "slope", [*keys, "m", "w"])
    if points is not None:
        z = written(z.select(*keys, "m", "w", "st", "z"), "votes")
        ties = z.filter(F.abs(F.abs("z") - float(mad_k)) <= TIE * float(mad_k)).select(*keys, "m", "w").distinct()
        if not ties.isEmpty():
            z = z.join(ties, [*keys, "m", "w"], "left_anti").unionByName(_direct(ties, points))
    up, down = F.col("z") > float(mad_k), F.col("z") < -float(mad_k)
    vote = {"positive": F.when(up, 1), "negative": F.when(down, 1), "both": F.when(up, 1).when(down, -1)}[direction]
    return z.select(*keys, "m", "w", "st", vote.cast("long").alias("vote")).filter("vote is not null")


def _prepared(signal: DataFrame, order_by: list[str], value: str, keys: list[str] | None, spread: bool = False) -> DataFrame:
    """(key, i, n, y, row): position, size and value of each point, and its row; with ``spread`` also its range and number."""
    series = signal.select(series_key(keys), named(value).cast("double").alias("y"), *(named(c).alias(f"o{k}") for k, c in enumerate(order_by)), F.struct(*(named(c) for c in signal.columns)).alias("row"))
    if spread:
        got = numbered(series, "key", [f"o{k}" for k in range(len(order_by))])
        return got.select("key", PART, ROW, (F.col(POS) - 1).alias("i"), F.col(SIZE).alias("n"), no_nan(F.col("y")).alias("y"), "row")
    own = Window.partitionBy("key")
    order = own.orderBy(*(f"o{k}" for k in range(len(order_by))))
    return series.select("key", (F.row_number().over(order).cast("long") - 1).alias("i"), F.count(F.lit(1)).over(own).alias("n"), no_nan(F.col("y")).alias("y"), "row")


def _options(lowwl, highwl, direction: str) -> int:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    if isinstance(highwl, str) and highwl.lower() != "auto":
        raise ValueError("highwl is a number or auto")
    return max(2, int(lowwl))


def _runs(series: DataFrame, low: int, highwl) -> DataFrame:
    """One run over each whole series; there a given highwl isn't cut to the series' length."""
    m = series.groupBy("key").agg(F.max("n").alias("m"))
    high = _highest(F.col("m"), low, highwl) if isinstance(highwl, str) else F.lit(max(low, int(highwl))).cast("long")
    return m.select("key", "m", F.lit(low).cast("long").alias("lo"), high.alias("hi"))


def _on_points(votes: DataFrame, runs: DataFrame, points: DataFrame, spread: bool = False) -> DataFrame:
    """(key, i, score) of ``points`` (key, i): the votes on each point over the number of lengths."""
    runs = runs.select("key", "m", (F.col("hi") - F.col("lo") + 1).alias("lengths"))
    step = lambda i, by: F.struct(i.alias("i"), by.alias("step"))
    steps = votes.select("key", F.explode(F.array(step(F.col("st"), F.col("vote")), step(F.col("st") + F.col("w"), -F.col("vote")))).alias("e")).groupBy("key", "e.i").agg(F.sum("e.step").alias("step"))
    if spread:
        every = points.select("key", PART, ROW, "i").join(steps, ["key", "i"], "left")
        return running_sums(every, "key", {"total": F.coalesce("step", F.lit(0))}).join(runs, "key").select("key", "i", (F.col("total") / F.col("lengths")).alias("score"))
    every = points.select("key", "i").join(steps, ["key", "i"], "left").join(runs, "key")
    total = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return every.select("key", "i", (total / F.col("lengths")).alias("score"))


def detect_asvotes(signal: DataFrame, order_by: list[str], value: str = "signal", lowwl: int = 5, highwl="auto", mad_k: float = 3, direction: str = "positive", keys: list[str] | None = None, spread: bool = False) -> DataFrame:
    """``signal`` with ``score``: the mean vote over all window lengths, in [-1, 1]; 0 for series of fewer than three points.

    ``spread`` is for very long series: sums and medians by ranges of rows, so that no task gets a whole series.
    """
    low = _options(lowwl, highwl, direction)
    unclashing(signal.columns, "score")
    series = _prepared(signal, order_by, value, keys, spread)
    runs = _runs(series, low, highwl)
    votes = block_votes(_spread_sums(series) if spread else _sums(series), runs, mad_k, direction, spread, series)
    got = series.join(_on_points(votes, runs, series, spread), ["key", "i"])
    return got.select("row.*", "score")


def detect_realtime(signal: DataFrame, time: str, value: str = "signal", lowwl: int = 5, highwl="auto", mad_k: float = 3.0, direction: str = "positive", burn_in: int | None = None, smooth_k: int = 30, threshold: float = 1.3, keys: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """(keys, time_ind, signal, detected_offline, detected_value_rt, flag, first_detection_time).

    Scores are in [-1, 1], so the default threshold is never reached: pass one that can be. Rows of the burn-in block see all of it.
    """
    low = _options(lowwl, highwl, direction)
    unclashing(keys, "time_ind", "signal", "detected_offline", "detected_value_rt", "flag", "first_detection_time")
    series = _prepared(signal, order_by or [time], value, keys)
    sums = _sums(series)
    first_block = burn_in if burn_in is not None else max(100, 5 * int(lowwl))
    burn = F.least(F.greatest(F.lit(2), F.lit(first_block)), F.col("size")).cast("long")
    size = series.groupBy("key").agg(F.max("n").alias("size")).withColumn("burn", burn)
    run = lambda m: m.select("key", "m", F.lit(low).cast("long").alias("lo"), _highest(F.col("m"), low, highwl).alias("hi"))
    first = run(size.select("key", F.col("burn").alias("m")))
    block = series.join(size, "key").filter("i < burn").select("key", "i")
    block = _on_points(block_votes(sums, first, mad_k, direction, points=series), first, block)
    k0 = max(1, int(smooth_k))
    early = block.select("key", "i", F.avg("score").over(Window.partitionBy("key").orderBy("i").rowsBetween(1 - k0, 0)).alias("rt"))
    late = prefix_scores(series, F.least(F.greatest(F.lit(2), F.lit(first_block)), F.col("n")).cast("long"), low, highwl, mad_k, direction, k0)
    runs = _runs(series, low, highwl)
    offline = _on_points(block_votes(sums, runs, mad_k, direction, points=series), runs, series)
    got = series.join(early.unionByName(late), ["key", "i"], "left").join(offline, ["key", "i"])
    rt = F.coalesce("rt", F.lit(0.0))
    at = F.col("row").getField(time)
    seen = F.min(F.when(rt >= float(threshold), F.struct(F.col("i"), at.alias("at")))).over(Window.partitionBy("key"))
    return got.select(*key_columns(keys), at.alias("time_ind"), F.col("y").alias("signal"), F.col("score").alias("detected_offline"), rt.alias("detected_value_rt"), (rt >= float(threshold)).alias("flag"), seen.getField("at").alias("first_detection_time"))
