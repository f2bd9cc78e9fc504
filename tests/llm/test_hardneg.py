"""Hard negatives against brute force: ties, repeated ids, copies, odd rows, several blocks and groups."""

import math

import numpy as np
from pyspark.sql import functions as F

from rampwise.llm import hardneg


def brute(rows, positives=5, negatives=10, low=30, high=90):
    own = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for n, (i, label, v) in enumerate(own):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, k, other) for k, (j, other, w) in enumerate(own) if k != n]
        for s, j, _, _ in sorted(x for x in scored if x[3] == label)[:positives]:
            found = sorted((t, k) for t, k, _, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(v, i, label, 1) for i, label, v in rows], "embedding array<double>, vec_id long, label int, score int").repartition(5)
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BUCKET", 32)
    monkeypatch.setattr(hardneg, "GROUP", 64)
    monkeypatch.setattr(hardneg, "BLOCK", 4)
    rng = np.random.RandomState(5)
    near = rng.randn(4, 8)
    rows = [(i, int(i % 4), (near[i % 4] * (i % 3) + rng.randn(8) * rng.rand() * 2).tolist()) for i in range(900)]
    rows += [(i, 1, near[1].tolist()) for i in range(900, 1300)]  # copies, anchors among them
    rows += [(i, 2, [round(x) / 4 for x in rng.randn(8)]) for i in range(1300, 1500)]  # ties
    rows += [(100, 1, near[2].tolist()), (100, 1, near[1].tolist()), (7, 3, near[3].tolist()), (7, 3, near[3].tolist())]
    rows += [(2000, None, near[0].tolist()), (None, 1, near[0].tolist()), (2100, 1, None), (2200, 1, [float("nan")] + [1.0] * 7), (2300, 1, [float("inf")] * 8), (2400, 1, [None] + [1.0] * 7), (2500, 0, [0.0] * 8), (2600, 9, [-0.001] * 8)]
    got = mined(spark, rows)
    assert len(got) > 500
    assert got == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [float(1 << 22) + i, 3.0 * i, -1.0]) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])]) == [(100, 1, 1, 2, 65536, 32768)]
