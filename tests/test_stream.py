"""The detector over micro-batches: order by event time, late points, burn-in rows, a restart from the checkpoint."""

import datetime as dt

import numpy as np

from rampwise.operators import detect
from rampwise.streaming.realtime import detect_stream

OPTIONS = {"lowwl": 4, "burn_in": 20, "smooth_k": 6, "mad_k": 2.0, "threshold": 0.05}


def signals(n=75):
    rs = np.random.RandomState(5)
    out = {}
    for k in ("a", "b"):
        y = rs.normal(size=n) + 1000
        y[40:52] += np.arange(12) * 3
        out[k] = y.tolist()
    out["a"][30] = None
    return out


def batch(spark, rows, kind):
    df = spark.createDataFrame(rows, f"k string, t {kind}, v double")
    return {(r.k, r.time_ind): r.detected_value_rt for r in detect.detect_realtime(df, "t", "v", keys=["k"], **OPTIONS).collect()}


def run(spark, source, kind, folder, name, **options):
    stream = spark.readStream.schema(f"k string, t {kind}, v double").option("maxFilesPerTrigger", 1).parquet(source)
    got = detect_stream(stream, "k", "t", "v", **OPTIONS, **options)
    q = got.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-c").trigger(availableNow=True).start()
    q.awaitTermination()


def put(spark, folder, rows, kind, nth):
    spark.createDataFrame(rows, f"k string, t {kind}, v double").coalesce(1).write.mode("append").parquet(f"{folder}/in{nth}")
    import pathlib
    import shutil

    target = pathlib.Path(folder.removeprefix("file://")) / "in"
    target.mkdir(exist_ok=True)
    for p in (pathlib.Path(folder.removeprefix("file://")) / f"in{nth}").glob("*.parquet"):
        shutil.copy(p, target / f"{nth}.parquet")


def test_batches_with_a_restart(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [(k, i, v) for k, y in signals().items() for i, v in enumerate(y)]
    for nth in range(5):
        put(spark, folder, [r for r in rows if 15 * nth <= r[1] < 15 * nth + 15][::-1], "long", nth)
        if nth in (2, 4):  # a restart after three micro-batches
            run(spark, f"{folder}/in", "long", folder, "out", burn_in_rows=True)
    want = batch(spark, rows, "long")
    got = spark.read.parquet(f"{folder}/out").collect()
    live = {(r.k, r.time_ind): r.detected_value_rt for r in got}
    assert len(got) == len(live) == len(want) == 150
    assert all(abs(live[p] - want[p]) < 1e-9 for p in want)
    assert [r.signal for r in got if r.k == "a" and r.time_ind == 30] == [None] and max(live.values()) > 0.05


def test_event_time_order_and_a_late_point(spark, tmp_path):
    folder, start = f"file://{tmp_path}", dt.datetime(2024, 1, 1)
    at = lambda i: start + dt.timedelta(minutes=i)
    rows = [(k, at(i), v) for k, y in signals().items() for i, v in enumerate(y)]
    late = [r for r in rows if r[1] == at(28)]  # comes two micro-batches after its time, within the delay
    for nth in range(5):
        own = [r for r in rows if at(15 * nth) <= r[1] < at(15 * nth + 15) and r not in late]
        put(spark, folder, (own + (late if nth == 3 else []))[::-1], "timestamp", nth)
    put(spark, folder, [("z", at(1000), 1.0), ("a", at(-500), 5.0)], "timestamp", 5)
    put(spark, folder, [("z", at(1001), 1.0), ("b", at(3), 77.0)], "timestamp", 6)  # far behind the watermark
    run(spark, f"{folder}/in", "timestamp", folder, "out", delay="40 minutes")
    want = batch(spark, rows, "timestamp")
    got = [r for r in spark.read.parquet(f"{folder}/out").collect() if r.k != "z"]
    live = {(r.k, r.time_ind): r.detected_value_rt for r in got}
    assert len(got) == len(live) == 2 * 55
    assert all(abs(v - want[p]) < 1e-9 for p, v in live.items())
