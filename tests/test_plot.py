"""The overlay by columns of pixels, its labels, and the plot where matplotlib is installed."""

import math

import pytest

from rampwise.sources import sinks


def rows(n):
    return [(i, math.sin(i / 50), None if i % 7 == 0 else 5 + math.cos(i / 30), 40 if i > 40 else None) for i in range(n)]


def test_rows_are_bounded_by_the_width_and_keep_extremes(spark):
    df = spark.createDataFrame(rows(5000), "time_ind long, detected_value_rt double, signal double, first_detection_time long").repartition(4)
    got = sinks.overlay_pixels(df, 100).orderBy("pixel").collect()
    assert [r.pixel for r in got] == list(range(100)) and sum(r.n for r in got) == 5000
    values = [(i, s, None if g is None else g * got[0].alpha) for i, s, g, _ in rows(5000)]
    for r in got:
        own = [v for v in values if r.x_first <= v[0] <= r.x_last]
        assert len(own) == r.n and (r.score_first, r.score_lo, r.score_hi, r.score_last) == (own[0][1], min(v[1] for v in own), max(v[1] for v in own), own[-1][1])
        some = [v[2] for v in own if v[2] is not None]
        assert (r.scaled_signal_first, r.scaled_signal_last) == (some[0], some[-1]) and math.isclose(r.scaled_signal_hi, max(some))
    x, y = sinks.line_points(got, "score")
    assert len(x) == len(y) == 400 and x == sorted(x)


def test_odd_tables(spark):
    text = spark.createDataFrame([("b", 1.0, 2.0), ("a", 2.0, 1.0), (None, 9.0, 9.0)], "time_ind string, detected_value_rt double, signal double")
    assert [(r.pixel, r.x_first) for r in sinks.overlay_pixels(text, 2).orderBy("pixel").collect()] == [(0, "a"), (1, "b")]
    assert [(r.pixel, r.n) for r in sinks.overlay_pixels(text.filter("time_ind = 'a'"), 9).collect()] == [(0, 1)]
    assert sinks.overlay_pixels(text.limit(0), 9).count() == 0
    assert sinks.tick_labels([0.0, 1.0, 1234.5, -0.00012345], 2.0) == ["0", "0.5", "617", "-6.17e-05"]


def test_plot(spark, tmp_path):
    matplotlib = pytest.importorskip("matplotlib")
    matplotlib.use("Agg")
    df = spark.createDataFrame(rows(500), "time_ind long, detected_value_rt double, signal double, first_detection_time long")
    fig, left, right = sinks.plot_detection_overlay(df, threshold=0.5, save_path=str(tmp_path / "o.png"), width=4, height=3, dpi=50, score_label="s", x_label="i")
    assert (tmp_path / "o.png").stat().st_size > 0 and left.get_ylabel() == "s" and left.get_xlabel() == "i"
    assert len(left.get_lines()) == 4 and right.get_ylim() == left.get_ylim()
