"""Queries of the time-series operators, by name, with their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.functions.numeric import robust_z
from rampwise.operators import arimax, detect, eigen, signals, spread, windows
from rampwise.operators.series import extract_x, na_handle, positioned
from rampwise.plans.fixtures import F1_SQL, F2_SQL, F4_SQL, daily, hourly, read, user_events, vectors
from rampwise.sources.scratch import shared_dir
from rampwise.sources.sinks import overlay_frame, overlay_pixels, write_rt_csv

CLICK_VIEW = ["click_m", "view_m"]
W = 48


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_asvotes(daily(spark, sf_dir), ["t"], "price").select("t", F.round("score", 10).alias("score"))


def _windows(**options):
    def run(spark, sf_dir):
        own = {"window": W} | options
        idx = own.pop("idx", False)
        got = windows.roll_windows(positioned(hourly(spark, sf_dir), ["t"]), "t", **own)
        return got.select("window_id", F.explode("idx").alias("member")) if idx else got.drop("idx")

    return run


def _windows_sql(window=W, step=1, align="end", type="rolling", idx=False) -> str:
    first = "1" if type == "expanding" else f"greatest(1, rn - {window} + 1)"
    at = {"end": "\"end\"", "start": "start", "center": "(start + \"end\") // 2"}[align]
    own = f"""with {F1_SQL}, w as (select case when n < {window} then 1 else (rn - {window}) // {step} + 1 end as window_id, {first} as start, rn as "end" from s
      where (rn >= {window} and (rn - {window}) % {step} = 0) or (n < {window} and rn = n))"""
    if idx:
        return own + ' select window_id, unnest(range(start, "end" + 1)) as member from w'
    return own + f' select window_id, start, "end", t as t_rep from w join s on s.rn = {at}'


def extract_list(spark, sf_dir):
    return extract_x(hourly(spark, sf_dir), ["view_m", "click_m"], ("t",)).select("t", F.round("view_m", 6).alias("view_m"), F.round("click_m", 6).alias("click_m"))


def extract_regex(spark, sf_dir):
    got = extract_x(hourly(spark, sf_dir), "click|sign", ("t",))
    return got.select("t", *(F.round(c, 6).alias(c) for c in got.columns if c != "t"))


def extract_coerce(spark, sf_dir):
    own = read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return extract_x(own, ["k", "event_type"], ("event_id",))


def _na(method):
    def run(spark, sf_dir):
        got = na_handle(hourly(spark, sf_dir).select("t", *CLICK_VIEW), CLICK_VIEW, method)
        return got.select("t", *(F.round(c, 6).alias(c) for c in CLICK_VIEW))

    return run


def _covariances(method):
    def run(spark, sf_dir):
        series = positioned(hourly(spark, sf_dir), ["t"])
        cov, _, n = eigen.covariances(series, CLICK_VIEW, windows.frame(W, "rolling"), method)
        got = windows.ends(series.select("pos", "n", n.alias("n_w"), *(F.round(v, 6).alias(f"s_{CLICK_VIEW.index(a)}_{CLICK_VIEW.index(b)}") for (a, b), v in cov.items())), W, 1)
        return got.select("window_id", "n_w", "s_0_0", "s_0_1", "s_1_1")

    return run


def _values(cols, **options):
    def run(spark, sf_dir):
        got = eigen.roll_svd(hourly(spark, sf_dir), "t", cols, **({"window": W} | options))
        return got.select("window_id", "t_rep", "n_w", F.round(F.get("d", F.lit(0)), 6).alias("d1"), F.round(F.try_element_at("d", F.lit(2)), 6).alias("d2"))

    return run


def eig3_roll(spark, sf_dir):
    got = eigen.roll_svd(hourly(spark, sf_dir), "t", ["click_m", "view_m", "error_m"], W)
    return got.select("window_id", "n_w", F.round(F.get("d", F.lit(0)), 6).alias("d1"))


def eig5_trace(spark, sf_dir):
    got = eigen.roll_svd(hourly(spark, sf_dir), "t", "_m|zzz", W)
    return got.select("window_id", "n_w", F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def _eig64(k: int | None):
    """All eigenvalues of windows of 64 columns, by their sum and sum of squares; or the first k."""

    def run(spark, sf_dir):
        got = eigen.roll_svd(vectors(spark, sf_dir), "vec_id", [f"e{i}" for i in range(64)], 128, step=32, k=k)
        if k:
            return got.select("window_id", "t_rep", F.posexplode("d").alias("at", "d")).select("window_id", "t_rep", (F.col("at") + 1).cast("long").alias("factor"), F.round("d", 6).alias("d"))
        return got.select("window_id", "start", "end", "t_rep", "n_w", F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"))

    return run


def tidy_values(spark, sf_dir):
    got = eigen.as_tibble_rollsvd(eigen.roll_svd(hourly(spark, sf_dir), "t", CLICK_VIEW, W))
    return got.select("window_id", "factor", F.round("d", 6).alias("d"))


def tidy_loadings2(spark, sf_dir):
    got = eigen.roll_svd(hourly(spark, sf_dir), "t", CLICK_VIEW, W, k=1, values_only=False)
    return eigen.as_tibble_rollsvd(got, "loadings", CLICK_VIEW).select("window_id", "variable", "factor", F.round("loading", 6).alias("loading"))


def scores2(spark, sf_dir):
    own = hourly(spark, sf_dir)
    got = eigen.roll_svd(own, "t", CLICK_VIEW, W, step=24, k=1, values_only=False)
    return eigen.scores(own, got, "t", CLICK_VIEW).select("window_id", "row_pos", "factor", F.round("score", 5).alias("score"))


def signal_raw(spark, sf_dir):
    return signals.build_signal_raw(hourly(spark, sf_dir), "t", "click_m").select("time_ind", F.round("signal", 6).alias("signal"))


def signal_svd(spark, sf_dir):
    return signals.build_signal_svd(hourly(spark, sf_dir), "t", CLICK_VIEW, W).select("time_ind", F.round("signal", 6).alias("signal"))


def arimax_ols_resid(spark, sf_dir):
    return arimax.ols_residuals(hourly(spark, sf_dir), "t", "click_m", "view_m").select("time", F.round("fitted", 6).alias("fitted"), F.round("residual", 6).alias("residual"))


KEYS = ["l_returnflag"]


def win_keyed(spark, sf_dir):
    return windows.roll_windows(positioned(daily(spark, sf_dir, tuple(KEYS)), ["t"], KEYS), "t", W, 7, "center", keys=KEYS).drop("idx")


def eig2_keyed(spark, sf_dir):
    got = eigen.roll_svd(daily(spark, sf_dir, tuple(KEYS)), "t", ["qty", "disc"], W, 3, keys=KEYS)
    return got.select(*KEYS, "window_id", "t_rep", "n_w", F.round(F.get("d", F.lit(0)), 6).alias("d1"), F.round(F.get("d", F.lit(1)), 6).alias("d2"))


def _arimax_keyed(order):
    """Two series of each key on one regressor, fitted key by key."""

    def run(spark, sf_dir):
        got = arimax.arimax_residuals_df(daily(spark, sf_dir, tuple(KEYS)), "t", ["qty", "price"], ["disc"], order, keys=KEYS)
        return got.select(*KEYS, "time", F.round("qty", 6).alias("qty"), F.round("price", 4).alias("price"))

    return run


def _arx1_keyed(spread: bool = False):
    def run(spark, sf_dir):
        got = arimax.arx_residuals(daily(spark, sf_dir, tuple(KEYS)), "t", "qty", "disc", keys=KEYS, spread=spread)
        return got.select(*KEYS, "time", F.round("fitted", 6).alias("fitted"), F.round("residual", 6).alias("residual"))

    return run


def arx1_resid(spark, sf_dir):
    return arimax.arx_residuals(hourly(spark, sf_dir), "t", "click_m", "view_m").select("time", F.round("fitted", 6).alias("fitted"), F.round("residual", 6).alias("residual"))


def arimax_resid_multi(spark, sf_dir):
    got = arimax.arimax_residuals_df(hourly(spark, sf_dir), "t", CLICK_VIEW, ["error_m"], (0, 0, 0))
    return got.select("time", *(F.round(c, 6).alias(c) for c in CLICK_VIEW))


def arimax_svd_ols(spark, sf_dir):
    got = signals.build_signal_arimax_svd(hourly(spark, sf_dir), "t", CLICK_VIEW, ["error_m"], W, order=(0, 0, 0))
    return got.select("time_ind", F.round("signal", 6).alias("signal"))


def arimax_then_svd_ols(spark, sf_dir):
    got = signals.arimax_then_roll_svd(hourly(spark, sf_dir), "t", CLICK_VIEW, ["error_m"], W, (0, 0, 0))
    return got.select("window_id", "t_rep", F.round(F.get("d", F.lit(0)), 6).alias("d1"))


def arimax_two_regressors(spark, sf_dir):
    got = arimax.ols_residuals(daily(spark, sf_dir, tuple(KEYS)), "t", "price", ["qty", "disc"], keys=KEYS)
    return got.select(*KEYS, "time", F.round("fitted", 4).alias("fitted"), F.round("residual", 4).alias("residual"))


def arimax_dependent(spark, sf_dir):
    """A constant regressor and one that repeats another have no effect."""
    own = daily(spark, sf_dir, tuple(KEYS)).select("*", F.lit(3.5).alias("same"), (2 * F.col("qty") + 1).alias("twice"))
    got = arimax.arimax_residuals_df(own, "t", ["price", "disc"], ["same", "qty", "twice"], (0, 0, 0), keys=KEYS)
    return got.select(*KEYS, "time", F.round("price", 4).alias("price"), F.round("disc", 8).alias("disc"))


def _arima(order, time="t", **options):
    """Errors of one ARMA part after a regression of qty on disc, key by key."""

    def run(spark, sf_dir):
        got = arimax.arimax_residuals(daily(spark, sf_dir, tuple(KEYS)), time, "qty", "disc", order, keys=KEYS, **options)
        return got.select(*KEYS, "time", F.round("fitted", 5).alias("fitted"), F.round("residual", 5).alias("residual"))

    return run


def _kpss_keyed(spread: bool = False):
    def run(spark, sf_dir):
        got = arimax.kpss(daily(spark, sf_dir, tuple(KEYS)), KEYS, "t", "qty", spread)
        return got.select(*KEYS, "n", F.round("statistic", 8).alias("statistic"))

    return run


def _seasonal_strength_keyed(spread: bool = False):
    """The strength of the weekly season, and of one of an even number of rows."""

    def run(spark, sf_dir):
        own = daily(spark, sf_dir, tuple(KEYS))
        both = [arimax.seasonal_strength(own, KEYS, "t", "qty", p, spread).withColumn("period", F.lit(p)) for p in (7, 12)]
        return both[0].unionByName(both[1]).select(*KEYS, "period", "n", F.round("strength", 8).alias("strength"))

    return run


def extract_names(spark, sf_dir):
    """Names aren't numbers: all of them are NULL."""
    return extract_x(read(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], ("c_custkey",)).select("c_custkey", "c_name", "c_acctbal")


def scores_keyed(spark, sf_dir):
    own = daily(spark, sf_dir, tuple(KEYS))
    got = eigen.roll_svd(own, "t", ["qty", "disc"], W, step=240, k=1, values_only=False, keys=KEYS)
    return eigen.scores(own, got, "t", ["qty", "disc"], keys=KEYS).select(*KEYS, "window_id", "row_pos", "factor", F.round("score", 5).alias("score"))


def tidy_keyed(spark, sf_dir):
    got = eigen.as_tibble_rollsvd(eigen.roll_svd(daily(spark, sf_dir, tuple(KEYS)), "t", ["qty", "disc"], W, 3, keys=KEYS), keys=KEYS)
    return got.select(*KEYS, "window_id", "factor", F.round("d", 6).alias("d"))


def arimax_auto(spark, sf_dir):
    """The searched order; no SQL, tested on simulated series."""
    return signals.build_signal_arimax_resid(hourly(spark, sf_dir), "t", "click_m", "view_m")


def _votes(**options):
    def run(spark, sf_dir):
        return detect.detect_asvotes(hourly(spark, sf_dir), ["t"], "click_m", **options).select("t", F.round("score", 10).alias("score"))

    return run


def votes_daily(spark, sf_dir):
    return flagship(spark, sf_dir)


def votes_keyed(spark, sf_dir):
    got = detect.detect_asvotes(user_events(spark, sf_dir), ["ts", "event_id"], "value", keys=["user_id"], mad_k=2)
    return got.select("user_id", "event_id", F.round("score", 10).alias("score"))


def win_spread(spark, sf_dir):
    return windows.roll_windows(positioned(hourly(spark, sf_dir), ["t"], spread=True), "t", W, 7).drop("idx")


def robust_z_spread(spark, sf_dir):
    """All prices of a line status are one group."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_extendedprice")
    return spread.robust_z(items, "l_linestatus", "l_extendedprice").select("l_orderkey", "l_linenumber", (F.round("z", 6) + F.lit(0.0)).alias("z"))


def robust_z_keyed(spark, sf_dir):
    return robust_z(user_events(spark, sf_dir), "value", ["user_id"]).select("event_id", F.round("z", 6).alias("z"))


def _realtime(**options):
    def run(spark, sf_dir):
        got = detect.detect_realtime(hourly(spark, sf_dir).withColumnRenamed("click_m", "signal").select("t", "signal"), "t", **({"threshold": 0.02} | options))
        return got.select("time_ind", F.round("detected_offline", 10).alias("detected_offline"), F.round("detected_value_rt", 10).alias("detected_value_rt"), "flag", "first_detection_time")

    return run


def rt_keyed(spark, sf_dir):
    own = user_events(spark, sf_dir)
    got = detect.detect_realtime(own, "event_id", "value", lowwl=4, mad_k=2, direction="both", burn_in=20, smooth_k=10, threshold=0.1, keys=["user_id"], order_by=["ts", "event_id"])
    return got.select("user_id", F.col("time_ind").alias("event_id"), *((F.round(c, 10) + F.lit(0.0)).alias(c) for c in ("detected_offline", "detected_value_rt")), "flag", F.col("first_detection_time").alias("first_event"))


def rt_overlay(spark, sf_dir):
    own = hourly(spark, sf_dir).select(F.col("t").alias("time_ind"), F.col("click_m").alias("detected_value_rt"), F.col("view_m").alias("signal"))
    got = overlay_frame(own)
    return got.select("x", F.round("score", 6).alias("score"), F.round("scaled_signal", 6).alias("scaled_signal"), F.round("alpha", 6).alias("alpha"))


def rt_pixels(spark, sf_dir):
    own = hourly(spark, sf_dir).select(F.col("t").alias("time_ind"), F.col("click_m").alias("detected_value_rt"), F.col("view_m").alias("signal"))
    got = overlay_pixels(own, 50)
    return got.select("pixel", "n", "x_first", "x_last", *(F.round(c, 6).alias(c) for c in got.columns if c.startswith(("score", "scaled"))))


def csv_roundtrip(spark, sf_dir):
    import uuid

    base = shared_dir(spark)
    path = write_rt_csv(hourly(spark, sf_dir).select("t", F.round("click_m", 6).alias("click_m"), (F.col("click_m") > 50).alias("flag")), f"{base.rstrip('/')}/csv-{uuid.uuid4().hex}")
    return spark.read.schema("t timestamp_ntz, click_m double, flag boolean").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def queries() -> dict:
    return {
        "win_rolling_end": _windows(), "win_rolling_start": _windows(align="start"), "win_rolling_center": _windows(align="center"), "win_step": _windows(step=7), "win_expanding": _windows(type="expanding", step=5), "win_expanding_center": _windows(type="expanding", align="center"), "win_short": _windows(window=5000), "win_members": _windows(step=24, idx=True),
        "extract_list": extract_list, "extract_regex": extract_regex, "extract_coerce": extract_coerce,
        "na_omit": _na("omit_rows"), "na_impute": _na("impute_mean"), "na_pairwise": _na("pairwise_complete"),
        "cov_pairs_omit": _covariances("omit_rows"), "cov_pairs_pairwise": _covariances("pairwise_complete"), "cov_pairs_impute": _covariances("impute_mean"),
        "eig2_roll": _values(CLICK_VIEW), "eig2_scaled": _values(CLICK_VIEW, scale_=True), "eig2_expanding": _values(CLICK_VIEW, type="expanding", step=3), "eig2_pairwise": _values(CLICK_VIEW, na_action="pairwise_complete", scale_=True), "eig2_impute": _values(CLICK_VIEW, na_action="impute_mean"), "eig1_variance": _values(["click_m"]),
        "eig3_roll": eig3_roll, "eig5_trace": eig5_trace, "tidy_values": tidy_values, "tidy_loadings2": tidy_loadings2, "scores2": scores2,
        "signal_raw": signal_raw, "signal_svd": signal_svd, "arimax_ols_resid": arimax_ols_resid, "arx1_resid": arx1_resid, "arimax_resid_multi": arimax_resid_multi, "arimax_svd_ols": arimax_svd_ols, "arimax_then_svd_ols": arimax_then_svd_ols, "arimax_auto": arimax_auto,
        "win_keyed": win_keyed, "eig2_keyed": eig2_keyed, "arimax_keyed": _arimax_keyed((0, 0, 0)), "arimax_diff_keyed": _arimax_keyed((0, 1, 0)), "arx1_keyed": _arx1_keyed(),
        "eig64_trace": _eig64(None), "eig64_topk": _eig64(3), "arimax_two_regressors": arimax_two_regressors, "arimax_dependent": arimax_dependent, "kpss_keyed": _kpss_keyed(), "extract_names": extract_names, "scores_keyed": scores_keyed, "tidy_keyed": tidy_keyed,
        "arima_100": _arima((1, 0, 0)), "arima_011": _arima((0, 1, 1), long_ar=1), "arima_111_given": _arima((1, 1, 1), given=([0.3], [-0.6])), "arima_seasonal_diff": _arima((0, 0, 0), period=7, seasonal_order=(0, 1, 0)), "arima_seasonal_ar": _arima((0, 0, 0), period=7, seasonal_order=(1, 0, 0)),
        "arima_seasonal_product": _arima((1, 0, 1), period=7, seasonal_order=(1, 0, 1), given=([0.3, 0.4], [-0.5, 0.2])), "seasonal_strength_keyed": _seasonal_strength_keyed(),
        "arx1_spread": _arx1_keyed(True), "kpss_spread": _kpss_keyed(True), "seasonal_strength_spread": _seasonal_strength_keyed(True), "arima_spread": _arima((1, 1, 1), given=([0.3], [-0.6]), spread=True),
        "votes_pos": _votes(), "votes_neg": _votes(direction="negative"), "votes_both": _votes(direction="both", mad_k=2), "votes_fixed_high": _votes(lowwl=4, highwl=40), "votes_daily": votes_daily, "votes_keyed": votes_keyed, "robust_z": robust_z_keyed,
        "votes_spread": _votes(spread=True), "eig2_spread": _values(CLICK_VIEW, scale_=True, spread=True), "win_spread": win_spread, "robust_z_spread": robust_z_spread,
        "rt_keyed": rt_keyed, "rt_flags": _realtime(), "rt_raw": _realtime(smooth_k=0, highwl=30, burn_in=200), "overlay_frame": rt_overlay, "overlay_pixels": rt_pixels, "eig2_long_window": _values(CLICK_VIEW, window=300, scale_=True), "csv_roundtrip": csv_roundtrip,
    }


FRAME = f"over (order by rn rows between {W - 1} preceding and current row)"


def _cov_sql(method: str, frame: str = FRAME, source: str = F1_SQL, a: str = "click_m", c: str = "view_m") -> str:
    """CTEs up to ``v``: rn, n, t, nw, saa, sac, scc, sda, sdc of each row's frame."""
    if method == "impute_mean":
        both = lambda x: f"coalesce(sum(case when a is not null and c is not null then {x} end) {frame}, 0)"
        return f"""with {source}, r as (select rn, n, t, {a} as a, {c} as c from s),
        q as (select rn, n, t, count(*) {frame} as nw, count(a) {frame} as na, count(c) {frame} as nc, avg(a) {frame} as ma, avg(c) {frame} as mc, var_samp(a) {frame} as va, var_samp(c) {frame} as vc,
          {both('a * c')} as xy, {both('a')} as xa, {both('c')} as xc, {both('1')} as nb from r),
        v as (select rn, n, t, nw, case when nw >= 2 and na > 1 and nc > 1 then va * (na - 1) / (nw - 1) end as saa, case when nw >= 2 and na > 1 and nc > 1 then vc * (nc - 1) / (nw - 1) end as scc,
          case when nw >= 2 and na > 1 and nc > 1 then (xy - mc * xa - ma * xc + nb * ma * mc) / (nw - 1) end as sac, 1.0::double as sda, 1.0::double as sdc from q)"""
    mask = f"{a} as a, {c} as c" if method == "pairwise_complete" else f"case when {c} is not null then {a} end as a, case when {a} is not null then {c} end as c"
    count = "count(*)" if method == "pairwise_complete" else "count(a)"
    return f"""with {source}, r as (select rn, n, t, {mask} from s),
    v as (select rn, n, t, {count} {frame} as nw, covar_samp(a, a) {frame} as saa, covar_samp(a, c) {frame} as sac, covar_samp(c, c) {frame} as scc, stddev_samp(a) {frame} as sda, stddev_samp(c) {frame} as sdc from r)"""


def _eig_sql(method="omit_rows", scale=False, step=1, frame=FRAME, source: str = F1_SQL, a="click_m", c="view_m") -> str:
    """CTEs up to ``e``: window_id, t, nw, d1, d2."""
    div = lambda x, s: f"{x} / ({s})" if scale else x
    sd = lambda x: f"(case when {x} > 1e-12 then {x} else 1 end)"
    return _cov_sql(method, frame, source, a, c) + f""",
    z as (select *, {div('saa', sd('sda') + ' * ' + sd('sda'))} as p, {div('sac', sd('sda') + ' * ' + sd('sdc'))} as q, {div('scc', sd('sdc') + ' * ' + sd('sdc'))} as r from v where rn >= {W} and (rn - {W}) % {step} = 0),
    e as (select (rn - {W}) // {step} + 1 as window_id, t, nw, (p + r) / 2 + sqrt(((p - r) / 2) * ((p - r) / 2) + q * q) as d1, (p + r) / 2 - sqrt(((p - r) / 2) * ((p - r) / 2) + q * q) as d2, p, q, r from z)"""


def _values_sql(**options) -> str:
    return _eig_sql(**options) + " select window_id, t as t_rep, nw as n_w, round(d1, 6) as d1, round(d2, 6) as d2 from e"


EIG3 = f"""with {F1_SQL}, r as (select rn, case when view_m is not null and error_m is not null then click_m end as a, case when click_m is not null and error_m is not null then view_m end as b, case when click_m is not null and view_m is not null then error_m end as c from s),
v as (select rn, count(a) {FRAME} as nw, covar_samp(a, a) {FRAME} as aa, covar_samp(b, b) {FRAME} as bb, covar_samp(c, c) {FRAME} as cc, covar_samp(a, b) {FRAME} as ab, covar_samp(a, c) {FRAME} as ac, covar_samp(b, c) {FRAME} as bc from r),
g as (select *, (aa + bb + cc) / 3 as q from v where rn >= {W}),
h as (select *, sqrt(((aa - q) * (aa - q) + (bb - q) * (bb - q) + (cc - q) * (cc - q) + 2 * (ab * ab + ac * ac + bc * bc)) / 6) as p from g),
k as (select *, ((aa - q) * ((bb - q) * (cc - q) - bc * bc) - ab * (ab * (cc - q) - bc * ac) + ac * (ab * bc - (bb - q) * ac)) / (2 * p * p * p) as det from h)
select rn - {W} + 1 as window_id, nw as n_w, round(q + 2 * p * cos(acos(greatest(-1, least(1, det))) / 3), 6) as d1 from k"""
_FIVE = ["click_m", "error_m", "purchase_m", "signup_m", "view_m"]
EIG5 = f"""with {F1_SQL}, r as (select rn, {', '.join(f"case when click_m + error_m + purchase_m + signup_m + view_m is not null then {c} end as {c}" for c in _FIVE)} from s),
v as (select rn, count(click_m) {FRAME} as nw, {' + '.join(f'var_samp({c}) {FRAME}' for c in _FIVE)} as total from r) select rn - {W} + 1 as window_id, nw as n_w, round(case when nw >= 2 then total end, 5) as total from v where rn >= {W}"""
#: The leading loadings of two columns by the sign rule.
_LOAD = """l as (select *, case when p >= r then d1 - r else q end as x, case when p >= r then q else d1 - p end as y from e where d1 is not null),
m as (select *, case when x = 0 and y = 0 then 1 else x / sqrt(x * x + y * y) end as vx, case when x = 0 and y = 0 then 0 else y / sqrt(x * x + y * y) end as vy from l),
o as (select *, case when abs(vx) >= abs(vy) then sign(vx) else sign(vy) end as g from m)"""
LOADINGS = _eig_sql() + f", {_LOAD} select window_id, 'click_m' as variable, 1 as factor, round(g * vx, 6) as loading from o union all select window_id, 'view_m', 1, round(g * vy, 6) from o"
SCORES = _eig_sql(step=24) + f""", {_LOAD}, w as (select o.window_id, g * vx as vx, g * vy as vy, s.rn, s.click_m as a, s.view_m as c from o join s on s.rn between (o.window_id - 1) * 24 + 1 and (o.window_id - 1) * 24 + {W} where s.click_m is not null and s.view_m is not null)
select window_id, rn as row_pos, 1 as factor, round((a - avg(a) over (partition by window_id)) * vx + (c - avg(c) over (partition by window_id)) * vy, 5) as score from w"""
OLS = f"""with {F1_SQL}, u as (select t, click_m as y, view_m as x from s where click_m is not null and view_m is not null), k as (select regr_slope(y, x) as b, regr_intercept(y, x) as a from u)
select t as time, round(a + b * x, 6) as fitted, round(y - (a + b * x), 6) as residual from u, k"""
ARX = f"""with {F1_SQL}, u as (select t, click_m as y, view_m as x from s where click_m is not null and view_m is not null), l as (select *, lag(y) over (order by t) as z from u), g as (select * from l where z is not null),
k as (select covar_samp(z, z) as zz, covar_samp(x, x) as xx, covar_samp(z, x) as zx, covar_samp(z, y) as zy, covar_samp(x, y) as xy, avg(y) as my, avg(z) as mz, avg(x) as mx from g),
f as (select t, y, my + (zy * xx - xy * zx) / (zz * xx - zx * zx) * (z - mz) + (xy * zz - zy * zx) / (zz * xx - zx * zx) * (x - mx) as fitted from g, k) select t as time, round(fitted, 6) as fitted, round(y - fitted, 6) as residual from f"""
_RESID = F1_SQL.replace("s as (", "s0 as (") + """, u as (select t, click_m, view_m, error_m from s0 where click_m is not null and view_m is not null and error_m is not null),
k as (select regr_slope(click_m, error_m) as b1, regr_intercept(click_m, error_m) as a1, regr_slope(view_m, error_m) as b2, regr_intercept(view_m, error_m) as a2 from u),
s as (select t, click_m - a1 - b1 * error_m as click_m, view_m - a2 - b2 * error_m as view_m, row_number() over (order by t) as rn, count(*) over () as n from u, k)"""


#: The same by key: windows, covariances of two columns, least squares, differences, one lag.
WIN_KEYED = f"""with {F4_SQL}, w as (select l_returnflag, (rn - {W}) // 7 + 1 as window_id, rn - {W} + 1 as start, rn as "end" from s where rn >= {W} and (rn - {W}) % 7 = 0)
select l_returnflag, window_id, start, "end", t as t_rep from w join s using (l_returnflag) where rn = (start + "end") // 2"""
_BY_KEY = f"over (partition by l_returnflag order by rn rows between {W - 1} preceding and current row)"
EIG2_KEYED = f"""with {F4_SQL}, v as (select l_returnflag, rn, t, count(*) {_BY_KEY} as n_w, covar_samp(qty, qty) {_BY_KEY} as p, covar_samp(qty, disc) {_BY_KEY} as q, covar_samp(disc, disc) {_BY_KEY} as r from s),
e as (select *, (p + r) / 2 as h, sqrt(((p - r) / 2) * ((p - r) / 2) + q * q) as g from v where rn >= {W} and (rn - {W}) % 3 = 0)
select l_returnflag, (rn - {W}) // 3 + 1 as window_id, t as t_rep, n_w, round(h + g, 6) as d1, round(h - g, 6) as d2 from e"""
ARIMAX_KEYED = f"""with {F4_SQL}, k as (select l_returnflag, regr_slope(qty, disc) as bq, regr_intercept(qty, disc) as aq, regr_slope(price, disc) as bp, regr_intercept(price, disc) as ap from s group by 1)
select l_returnflag, t as time, round(qty - aq - bq * disc, 6) as qty, round(price - ap - bp * disc, 4) as price from s join k using (l_returnflag)"""
ARIMAX_DIFF_KEYED = f"""with {F4_SQL}, d as (select l_returnflag, t, qty - lag(qty) over g as qty, price - lag(price) over g as price, disc - lag(disc) over g as disc from s window g as (partition by l_returnflag order by t)),
k as (select l_returnflag, sum(qty * disc) / sum(disc * disc) as bq, sum(price * disc) / sum(disc * disc) as bp from d group by 1)
select l_returnflag, t as time, round(coalesce(qty - bq * disc, 0), 6) as qty, round(coalesce(price - bp * disc, 0), 4) as price from d join k using (l_returnflag)"""
ARX_KEYED = f"""with {F4_SQL}, g as (select l_returnflag, t, qty as y, disc as x, lag(qty) over (partition by l_returnflag order by t) as z from s), u as (select * from g where z is not null),
k as (select l_returnflag, covar_samp(z, z) as zz, covar_samp(x, x) as xx, covar_samp(z, x) as zx, covar_samp(z, y) as zy, covar_samp(x, y) as xy, avg(y) as my, avg(z) as mz, avg(x) as mx from u group by 1),
f as (select l_returnflag, t, y, my + (zy * xx - xy * zx) / (zz * xx - zx * zx) * (z - mz) + (xy * zz - zy * zx) / (zz * xx - zx * zx) * (x - mx) as fitted from u join k using (l_returnflag))
select l_returnflag, t as time, round(fitted, 6) as fitted, round(y - fitted, 6) as residual from f"""


PIXELS = f"""with {F1_SQL}, a as (select coalesce(nullif((max(click_m) - min(click_m)) / nullif(max(view_m) - min(view_m), 0), 0), 1) as alpha, min(epoch_us(t)) as lo, max(epoch_us(t)) as hi from s),
p as (select t, click_m as score, view_m * alpha as scaled, cast(least(49, floor((epoch_us(t) - lo)::double / (hi - lo)::double * 50)) as bigint) as pixel from s, a)
select pixel, count(*) as n, min(t) as x_first, max(t) as x_last, {', '.join(f"round(arg_min({v}, t) filter ({v} is not null), 6) as {c}_first, round(min({v}), 6) as {c}_lo, round(max({v}), 6) as {c}_hi, round(arg_max({v}, t) filter ({v} is not null), 6) as {c}_last" for v, c in (("score", "score"), ("scaled", "scaled_signal")))} from p group by 1"""
ROBUST_ALL = """with m as (select l_linestatus, median(l_extendedprice) as m from lineitem group by 1), d as (select l_linestatus, median(abs(l_extendedprice - m)) as d from lineitem join m using (l_linestatus) group by 1)
select l_orderkey, l_linenumber, round((l_extendedprice - m) / case when d > 0 then d else 1e-8 end, 6) + 0 as z from lineitem join m using (l_linestatus) join d using (l_linestatus)"""
#: 64 columns: each one's variance, and the squares of all pairs' covariances, window by window.
EIG64 = """with s as (select vec_id, row_number() over (order by vec_id) as rn, embedding as e from embeddings),
w as (select (rn - 128) // 32 + 1 as window_id, rn - 127 as start, rn as "end", vec_id as t_rep from s where rn >= 128 and (rn - 128) % 32 = 0),
x as (select window_id, rn, unnest(range(1, 65)) as i, e from w join s on rn between start and "end"), y as (select window_id, rn, i, cast(e[i] as double) as v from x),
c as (select a.window_id, a.i, b.i as j, covar_samp(a.v, b.v) as c from y a join y b on a.window_id = b.window_id and a.rn = b.rn group by 1, 2, 3),
g as (select window_id, sum(case when i = j then c end) as total, sum(c * c) as squares from c group by 1)
select w.*, 128 as n_w, round(total, 6) as total, round(squares, 6) as squares from w join g using (window_id)"""
TWO = f"""with {F4_SQL}, k as (select l_returnflag, covar_pop(qty, qty) as aa, covar_pop(disc, disc) as bb, covar_pop(qty, disc) as ab, covar_pop(qty, price) as ay, covar_pop(disc, price) as yb, avg(price) as my, avg(qty) as ma, avg(disc) as mb from s group by 1),
f as (select l_returnflag, t, price, my + (ay * bb - yb * ab) / (aa * bb - ab * ab) * (qty - ma) + (yb * aa - ay * ab) / (aa * bb - ab * ab) * (disc - mb) as fitted from s join k using (l_returnflag))
select l_returnflag, t as time, round(fitted, 4) as fitted, round(price - fitted, 4) as residual from f"""
DEPENDENT = f"""with {F4_SQL}, k as (select l_returnflag, regr_slope(price, qty) as bp, regr_intercept(price, qty) as ap, regr_slope(disc, qty) as bd, regr_intercept(disc, qty) as ad from s group by 1)
select l_returnflag, t as time, round(price - ap - bp * qty, 4) as price, round(disc - ad - bd * qty, 8) as disc from s join k using (l_returnflag)"""
KPSS = f"""with {F4_SQL}, z as (select l_returnflag, rn, n, qty - avg(qty) over (partition by l_returnflag) as z, floor(4 * power(n / 100, 0.25)) as lags from s),
p as (select *, sum(z) over (partition by l_returnflag order by rn) as s from z),
g as (select l_returnflag, max(n) as n, sum(s * s) / max(n) / max(n) as eta, sum(z * z) / max(n) as g0 from p group by 1),
c as (select a.l_returnflag, sum((1 - (a.rn - b.rn) / (a.lags + 1)) * a.z * b.z) / max(a.n) as w from z a join z b on a.l_returnflag = b.l_returnflag and b.rn < a.rn and b.rn >= a.rn - a.lags group by 1)
select l_returnflag, n, round(eta / (g0 + 2 * w), 8) as statistic from g join c using (l_returnflag)"""
SCORES_KEYED = f"""with {F4_SQL}, w as (select l_returnflag, (rn - {W}) // 240 + 1 as window_id, rn - {W} + 1 as start, rn as "end" from s where rn >= {W} and (rn - {W}) % 240 = 0),
x as (select w.l_returnflag, window_id, rn, qty - avg(qty) over g as a, disc - avg(disc) over g as b from w join s on w.l_returnflag = s.l_returnflag and rn between start and "end" window g as (partition by w.l_returnflag, window_id)),
v as (select l_returnflag, window_id, sum(a * a) / {W - 1} as p, sum(a * b) / {W - 1} as q, sum(b * b) / {W - 1} as r from x group by 1, 2),
e as (select *, (p + r) / 2 + sqrt(((p - r) / 2) * ((p - r) / 2) + q * q) as d from v), l as (select *, case when p >= r then d - r else q end as vx, case when p >= r then q else d - p end as vy from e),
m as (select *, sqrt(vx * vx + vy * vy) * case when abs(vx) >= abs(vy) then sign(vx) else sign(vy) end as g from l)
select l_returnflag, window_id, rn as row_pos, 1 as factor, round((a * vx + b * vy) / g, 5) as score from x join m using (l_returnflag, window_id)"""
TIDY_KEYED = EIG2_KEYED.split("\nselect l_returnflag, (rn")[0] + f""" select l_returnflag, (rn - {W}) // 3 + 1 as window_id, 1 as factor, round(h + g, 6) as d from e union all select l_returnflag, (rn - {W}) // 3 + 1, 2, round(h - g, 6) from e"""


def _arma_sql(lag: int, differenced: bool, given: tuple[float, float] | None, ma: bool) -> str:
    """qty on disc (after a difference of ``lag`` rows, without a constant, or not), then AR of lag ``lag`` or the errors of MA(1)."""
    over = "(partition by l_returnflag order by rn)"
    if differenced:
        own = f"""d as (select l_returnflag, rn, t, qty, qty - lag(qty, {lag}) over {over} as y, disc - lag(disc, {lag}) over {over} as x from s),
        k as (select l_returnflag, sum(y * x) / sum(x * x) as b from d group by 1), u as (select l_returnflag, t, qty, rn - {lag} as i, y - b * x as u from d join k using (l_returnflag) where rn > {lag})"""
    else:
        own = """k as (select l_returnflag, regr_slope(qty, disc) as b, regr_intercept(qty, disc) as a from s group by 1), u as (select l_returnflag, t, qty, rn as i, qty - a - b * disc as u from s join k using (l_returnflag))"""
    out = f"with recursive {F4_SQL}, {own}, "
    along = "(partition by l_returnflag order by i)"
    if not ma and not given:
        return out + f"""l as (select *, coalesce(lag(u, {lag}) over {along}, 0) as z from u), r as (select l_returnflag, sum(u * z) / sum(z * z) as a from l group by 1),
        select_ as (select l_returnflag, t, qty, u - a * z as e from l join r using (l_returnflag)) select l_returnflag, t as time, round(qty - e, 5) as fitted, round(e, 5) as residual from select_"""
    if given:
        out += f"th as (select distinct l_returnflag, {given[1]} as m from u), cc as (select u.*, u - {given[0]} * coalesce(lag(u) over {along}, 0) as c from u), "
    else:
        out += f"""l as (select *, coalesce(lag(u) over {along}, 0) as z from u), r as (select l_returnflag, sum(u * z) / sum(z * z) as a from l group by 1),
        p as (select l.*, u - a * z as w from l join r using (l_returnflag)), p2 as (select *, coalesce(lag(w) over {along}, 0) as w1 from p), th as (select l_returnflag, sum(u * w1) / sum(w1 * w1) as m from p2 group by 1), cc as (select *, u as c from u), """
    return out + """e as (select l_returnflag, i, t, qty, c as e from cc where i = 1 union all select cc.l_returnflag, cc.i, cc.t, cc.qty, cc.c - m * e.e from e join cc on cc.l_returnflag = e.l_returnflag and cc.i = e.i + 1 join th on th.l_returnflag = e.l_returnflag)
    select l_returnflag, t as time, round(qty - e, 5) as fitted, round(e, 5) as residual from e union all select l_returnflag, t, round(qty, 5), 0 from s where rn = 1"""


SEASONAL_DIFF = f"""with {F4_SQL}, d as (select l_returnflag, rn, t, qty, qty - lag(qty, 7) over (partition by l_returnflag order by rn) as y, disc - lag(disc, 7) over (partition by l_returnflag order by rn) as x from s),
k as (select l_returnflag, sum(y * x) / sum(x * x) as b from d group by 1), e as (select l_returnflag, t, qty, coalesce(y - b * x, 0) as e from d join k using (l_returnflag))
select l_returnflag, t as time, round(qty - e, 5) as fitted, round(e, 5) as residual from e"""


SEASONAL_PRODUCT = f"""with recursive {F4_SQL}, k as (select l_returnflag, regr_slope(qty, disc) as b, regr_intercept(qty, disc) as a from s group by 1),
u as (select l_returnflag, t, qty, rn as i, qty - a - b * disc as u from s join k using (l_returnflag)),
cc as (select *, u - 0.3 * coalesce(lag(u) over w, 0) - 0.4 * coalesce(lag(u, 7) over w, 0) + 0.12 * coalesce(lag(u, 8) over w, 0) as c from u window w as (partition by l_returnflag order by i)),
e as (select l_returnflag, i, t, qty, [c, 0, 0, 0, 0, 0, 0, 0]::double[] as h from cc where i = 1
  union all select cc.l_returnflag, cc.i, cc.t, cc.qty, list_prepend(cc.c + 0.5 * h[1] - 0.2 * h[7] + 0.1 * h[8], h[1:7]) from e join cc on cc.l_returnflag = e.l_returnflag and cc.i = e.i + 1)
select l_returnflag, t as time, round(qty - h[1], 5) as fitted, round(h[1], 5) as residual from e"""


def _strength_sql(m: int) -> str:
    """CTEs up to ``r{m}``: l_returnflag, period, n, strength."""
    half, over = m // 2, "(partition by l_returnflag order by rn rows between {} preceding and {} following)"
    trend = f"sum(qty) over {over.format(half, half)}"
    trend = trend if m % 2 else f"({trend} + sum(qty) over {over.format(half - 1, half - 1)}) / 2"
    return f"""d{m} as (select l_returnflag, rn % {m} as phase, n, case when rn > {half} and rn <= n - {half} then qty - {trend} / {m} end as z from s),
p{m} as (select *, avg(z) over (partition by l_returnflag, phase) as mp, avg(z) over (partition by l_returnflag) as m0 from d{m}),
r{m} as (select l_returnflag, {m} as period, max(n) as n, round(sum((mp - m0) * (mp - m0)) / sum((z - m0) * (z - m0)), 8) as strength from p{m} where z is not null group by 1)"""


STRENGTHS = f"with {F4_SQL}, {_strength_sql(7)}, {_strength_sql(12)} select * from r7 union all select * from r12"


def _votes_sql(source: str, keys: str = "", order: str = "t", low: int = 5, high: str = "auto", k: float = 3, direction: str = "positive") -> str:
    """CTEs up to ``res`` (keys, i, score) over ``source`` (CTEs that end in y0: keys, order columns, y)."""
    p, kc = (f"partition by {keys} ", f"{keys}, ") if keys else ("", "")
    join = f"g.{keys} = x.{keys} and " if keys else ""
    hi = f"greatest(5, n // 3, {low})" if high == "auto" else f"greatest({high}, {low})"
    sign = {"positive": f"case when z > {k} then 1 else 0 end", "negative": f"case when z < -{k} then 1 else 0 end", "both": f"case when z > {k} then 1 when z < -{k} then -1 else 0 end"}[direction]
    return f"""with {source}, y1 as (select *, row_number() over ({p}order by {order}) - 1 as i, count(*) over ({p}) as n from y0),
    g0 as (select {kc}i, y, n, unnest(range({low}, {hi} + 1)) as w from y1 where n >= 3), g1 as (select *, (n % w) // 2 as pad, n // w as nb from g0),
    g as (select *, (i - pad) // w as b, (i - pad) % w as j from g1 where i >= pad and i - pad < nb * w),
    sl as (select {kc}w, b, case when count(y) = w then sum((j + 1 - (w + 1) / 2.0::double) * y) / (w::double * (w::double * w - 1) / 12) end as slope from g group by {kc}w, b),
    md as (select {kc}w, median(slope) as m from sl group by {kc}w), ab as (select {kc}w, median(abs(slope - m)) as d from sl join md using ({kc}w) group by {kc}w),
    z0 as (select {kc}w, b, (slope - m) / case when d > 0 then d else 1e-8 end as z from sl join md using ({kc}w) join ab using ({kc}w)),
    x as (select {kc}w, b, {sign} as vote from z0 where z is not null),
    res0 as (select {'g.' + keys + ', ' if keys else ''}g.i, sum(vote) as votes from g join x on {join}g.w = x.w and g.b = x.b where vote <> 0 group by all),
    res as (select y1.*, coalesce(votes, 0)::double / ({hi} - {low} + 1) as score from y1 left join res0 using ({kc}i))"""


_CLICK = F1_SQL + ", y0 as (select t, click_m as y from s)"


def _rt_sql(low: int = 5, high: int | None = None, k: float = 3, burn_in: int = 100, smooth: int = 30, threshold: float = 0.02) -> str:
    """The prefix-sum form after burn-in, the direct form before and offline."""
    hi = lambda m: f"greatest(5, {m} // 3, {low})" if high is None else f"greatest({low}, least({high}, {m}))"
    k0 = max(1, smooth)
    offline = _votes_sql(_CLICK, low=low, high="auto" if high is None else str(high), k=k)
    return offline + f""", nn as (select max(n) as n, least(greatest(2, {burn_in}), max(n)) as burn from y1),
    c as (select i, y - avg(y) over () as y from y1),
    ps as (select 0 as at, 0.0::double as s, 0.0::double as t, 0 as c union all select i + 1, sum(coalesce(y, 0)) over (order by i), sum(i * coalesce(y, 0)) over (order by i), sum(case when y is null then 1 else 0 end) over (order by i) from c),
    ms as (select unnest(range(burn, n + 1)) as m from nn), wl as (select m, unnest(range({low}, {hi('m')} + 1)) as w from ms), bl as (select m, w, unnest(range(0, m // w)) as b from wl where w <= m),
    bs as (select m, w, (m % w) // 2 + w * b as st from bl),
    sp as (select m, w, st, ((b.t - a.t) - (st + (w - 1) / 2.0::double) * (b.s - a.s)) / (w::double * (w::double * w - 1) / 12) as slope from bs join ps a on a.at = st join ps b on b.at = st + w where a.c = b.c),
    pm as (select m, w, median(slope) as med from sp group by m, w), pa as (select m, w, median(abs(slope - med)) as d from sp join pm using (m, w) group by m, w),
    hit as (select m, w, st from sp join pm using (m, w) join pa using (m, w) where (slope - med) / case when d > 0 then d else 1e-8 end > {k}),
    late as (select m - 1 as i, sum(greatest(0, st + w - greatest(m - least({k0}, m), st)))::double / (least({k0}, m) * ({hi('m')} - {low} + 1)) as rt from hit, nn where m > burn group by m),
    raw0 as (select i, count(*)::double / ({hi('burn')} - {low} + 1) as r from (select unnest(range(st, st + w)) as i, burn from hit, nn where m = burn) group by i, burn),
    early as (select i, avg(coalesce(r, 0)) over (order by i rows between {k0 - 1} preceding and current row) as rt from y1 left join raw0 using (i), nn where i < burn),
    fin as (select t as time_ind, round(score, 10) as detected_offline, coalesce(e.rt, l.rt, 0) as rt from res left join early e using (i) left join late l using (i))
    select time_ind, detected_offline, round(rt, 10) as detected_value_rt, rt >= {threshold} as flag, (select min(time_ind) from fin where rt >= {threshold}) as first_detection_time from fin"""


def _rt_keyed_sql(low: int = 4, k: float = 2, burn_in: int = 20, smooth: int = 10, threshold: float = 0.1) -> str:
    """The same for each user's events, both directions."""
    hi = lambda m: f"greatest(5, {m} // 3, {low})"
    offline = _votes_sql("y0 as (select user_id, ts, event_id, value as y from events)", "user_id", "ts, event_id", low=low, k=k, direction="both")
    return offline + f""", nn as (select user_id, max(n) as n, least(greatest(2, {burn_in}), max(n)) as burn from y1 group by 1),
    c as (select user_id, i, y - avg(y) over (partition by user_id) as y from y1),
    ps as (select user_id, 0 as at, 0.0::double as s, 0.0::double as t, 0 as c from nn union all
      select user_id, i + 1, sum(coalesce(y, 0)) over (partition by user_id order by i), sum(i * coalesce(y, 0)) over (partition by user_id order by i), sum(case when y is null then 1 else 0 end) over (partition by user_id order by i) from c),
    ms as (select user_id, burn, unnest(range(burn, n + 1)) as m from nn), wl as (select user_id, burn, m, unnest(range({low}, {hi('m')} + 1)) as w from ms), bl as (select user_id, burn, m, w, unnest(range(0, m // w)) as b from wl where w <= m),
    bs as (select user_id, burn, m, w, (m % w) // 2 + w * b as st from bl),
    sp as (select bs.user_id, burn, m, w, st, ((b.t - a.t) - (st + (w - 1) / 2.0::double) * (b.s - a.s)) / (w::double * (w::double * w - 1) / 12) as slope
      from bs join ps a on a.user_id = bs.user_id and a.at = st join ps b on b.user_id = bs.user_id and b.at = st + w where a.c = b.c),
    pm as (select user_id, m, w, median(slope) as med from sp group by 1, 2, 3), pa as (select user_id, m, w, median(abs(slope - med)) as d from sp join pm using (user_id, m, w) group by 1, 2, 3),
    hz as (select user_id, burn, m, w, st, (slope - med) / case when d > 0 then d else 1e-8 end as z from sp join pm using (user_id, m, w) join pa using (user_id, m, w)),
    hit as (select *, case when z > {k} then 1 else -1 end as vote from hz where abs(z) > {k}),
    late as (select user_id, m - 1 as i, sum(vote * greatest(0, st + w - greatest(m - least({smooth}, m), st)))::double / (least({smooth}, m) * ({hi('m')} - {low} + 1)) as rt from hit where m > burn group by user_id, m),
    raw0 as (select user_id, i, sum(vote)::double / ({hi('burn')} - {low} + 1) as r from (select user_id, unnest(range(st, st + w)) as i, burn, vote from hit where m = burn) group by user_id, i, burn),
    early as (select user_id, i, avg(coalesce(r, 0)) over (partition by user_id order by i rows between {smooth - 1} preceding and current row) as rt from y1 left join raw0 using (user_id, i) join nn using (user_id) where i < burn),
    fin as (select user_id, i, event_id, round(score, 10) as detected_offline, coalesce(e.rt, l.rt, 0) as rt from res left join early e using (user_id, i) left join late l using (user_id, i)),
    fd as (select user_id, arg_min(event_id, i) as first_event from fin where rt >= {threshold} group by 1)
    select user_id, event_id, detected_offline + 0 as detected_offline, round(rt, 10) + 0 as detected_value_rt, rt >= {threshold} as flag, first_event from fin left join fd using (user_id)"""


def oracle_sql() -> dict[str, str]:
    r6 = lambda *cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)
    votes = lambda **o: _votes_sql(_CLICK, **o) + " select t, round(score, 10) as score from res"
    covs = lambda m: _cov_sql(m) + f" select rn - {W} + 1 as window_id, nw as n_w, round(saa, 6) as s_0_0, round(sac, 6) as s_0_1, round(scc, 6) as s_1_1 from v where rn >= {W}"
    expanding = "over (order by rn rows between unbounded preceding and current row)"
    return {
        "win_rolling_end": _windows_sql(), "win_rolling_start": _windows_sql(align="start"), "win_rolling_center": _windows_sql(align="center"), "win_step": _windows_sql(step=7), "win_expanding": _windows_sql(type="expanding", step=5), "win_expanding_center": _windows_sql(type="expanding", align="center"), "win_short": _windows_sql(window=5000), "win_members": _windows_sql(step=24, idx=True),
        "extract_list": f"with {F1_SQL} select t, {r6('view_m', 'click_m')} from s", "extract_regex": f"with {F1_SQL} select t, {r6('click_m', 'signup_m')} from s",
        "extract_coerce": "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, try_cast(event_type as double) as event_type from events",
        "na_omit": f"with {F1_SQL} select t, {r6(*CLICK_VIEW)} from s where click_m is not null and view_m is not null", "na_pairwise": f"with {F1_SQL} select t, {r6(*CLICK_VIEW)} from s",
        "na_impute": f"with {F1_SQL} select t, round(coalesce(click_m, case when count(click_m) over () > 1 then avg(click_m) over () end), 6) as click_m, round(coalesce(view_m, case when count(view_m) over () > 1 then avg(view_m) over () end), 6) as view_m from s",
        "cov_pairs_omit": covs("omit_rows"), "cov_pairs_pairwise": covs("pairwise_complete"), "cov_pairs_impute": covs("impute_mean"),
        "eig2_roll": _values_sql(), "eig2_scaled": _values_sql(scale=True), "eig2_expanding": _values_sql(step=3, frame=expanding), "eig2_pairwise": _values_sql(method="pairwise_complete", scale=True), "eig2_impute": _values_sql(method="impute_mean"),
        "eig1_variance": f"with {F1_SQL}, v as (select rn, t, count(click_m) {FRAME} as nw, var_samp(click_m) {FRAME} as d from s) select rn - {W} + 1 as window_id, t as t_rep, nw as n_w, round(d, 6) as d1, null::double as d2 from v where rn >= {W}",
        "eig3_roll": EIG3, "eig5_trace": EIG5, "tidy_values": _eig_sql() + " select window_id, 1 as factor, round(d1, 6) as d from e where d1 is not null union all select window_id, 2, round(d2, 6) from e where d2 is not null", "tidy_loadings2": LOADINGS, "scores2": SCORES,
        "signal_raw": f"with {F1_SQL} select t as time_ind, round(click_m, 6) as signal from s", "signal_svd": _eig_sql(scale=True) + " select t as time_ind, round(d1, 6) as signal from e",
        "arimax_ols_resid": OLS, "arx1_resid": ARX, "arimax_resid_multi": f"with {_RESID} select t as time, {r6(*CLICK_VIEW)} from s",
        "arimax_svd_ols": _eig_sql(scale=True, source=_RESID) + " select t as time_ind, round(d1, 6) as signal from e", "arimax_then_svd_ols": _eig_sql(source=_RESID) + " select window_id, t as t_rep, round(d1, 6) as d1 from e",
        "win_keyed": WIN_KEYED, "eig2_keyed": EIG2_KEYED, "arimax_keyed": ARIMAX_KEYED, "arimax_diff_keyed": ARIMAX_DIFF_KEYED, "arx1_keyed": ARX_KEYED,
        "eig64_trace": EIG64, "arimax_two_regressors": TWO, "arimax_dependent": DEPENDENT, "kpss_keyed": KPSS, "extract_names": "select c_custkey, null::double as c_name, c_acctbal from customer", "scores_keyed": SCORES_KEYED, "tidy_keyed": TIDY_KEYED,
        "arima_100": _arma_sql(1, False, None, False), "arima_011": _arma_sql(1, True, None, True), "arima_111_given": _arma_sql(1, True, (0.3, -0.6), True), "arima_seasonal_diff": SEASONAL_DIFF, "arima_seasonal_ar": _arma_sql(7, False, None, False),
        "arima_seasonal_product": SEASONAL_PRODUCT, "seasonal_strength_keyed": STRENGTHS,
        "arx1_spread": ARX_KEYED, "kpss_spread": KPSS, "seasonal_strength_spread": STRENGTHS, "arima_spread": _arma_sql(1, True, (0.3, -0.6), True),
        "votes_pos": votes(), "votes_neg": votes(direction="negative"), "votes_both": votes(direction="both", k=2), "votes_fixed_high": votes(low=4, high="40"),
        "votes_daily": _votes_sql(F2_SQL + ", y0 as (select t, price as y from f2)") + " select t, round(score, 10) as score from res",
        "votes_keyed": _votes_sql("y0 as (select user_id, ts, event_id, value as y from events)", "user_id", "ts, event_id", k=2) + " select user_id, event_id, round(score, 10) as score from res",
        "robust_z": "with m as (select user_id, median(value) as m from events group by 1), d as (select user_id, median(abs(value - m)) as d from events join m using (user_id) group by 1) select event_id, round((value - m) / case when d > 0 then d else 1e-8 end, 6) as z from events join m using (user_id) join d using (user_id)",
        "votes_spread": votes(), "eig2_spread": _values_sql(scale=True), "win_spread": _windows_sql(step=7), "robust_z_spread": ROBUST_ALL,
        "rt_keyed": _rt_keyed_sql(), "rt_flags": _rt_sql(), "rt_raw": _rt_sql(high=30, burn_in=200, smooth=0),
        "overlay_frame": f"with {F1_SQL}, a as (select coalesce(nullif((max(click_m) - min(click_m)) / nullif(max(view_m) - min(view_m), 0), 0), 1) as alpha from s) select t as x, round(click_m, 6) as score, round(view_m * alpha, 6) as scaled_signal, round(alpha, 6) as alpha from s, a",
        "overlay_pixels": PIXELS, "eig2_long_window": _values_sql(scale=True).replace(f"{W - 1} preceding", "299 preceding").replace(f"rn >= {W}", "rn >= 300").replace(f"(rn - {W})", "(rn - 300)"),
        "csv_roundtrip": f"with {F1_SQL} select t, round(click_m, 6) as click_m, click_m > 50 as flag from s",
    }
