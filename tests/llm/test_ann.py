"""Nearest neighbours where many vectors are equal."""

from collections import defaultdict

import numpy as np
import pandas as pd

from rampwise.llm import ann


def test_centroids_are_distinct_and_not_empty():
    x = np.random.RandomState(1).normal(size=(3000, 8))
    x[: len(x) // 3] = x[0]
    c = ann.balanced_centroids(x, 90)
    assert len(np.unique(c, axis=0)) == len(c)
    assert len(np.unique(ann.distances(x, c).argmin(axis=1))) == len(c)


def test_equal_vectors(spark):
    random = np.random.RandomState(2)
    x = random.normal(size=(24_000, 8)).round(6)
    x[random.rand(len(x)) < 0.6] = x[1]
    vectors = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann.search(vectors, vectors.filter("vec_id % 200 = 0")).collect()):
        got[r.query_id].append(r.vec_id)
    hits, asked = 0, range(0, len(x), 200)
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((np.arange(len(x)), d)) if k != q][:10]
        assert len(got[q]) == 10
        if (x[q] == x[1]).all():
            assert got[q] == best
        hits += len(set(got[q]) & set(best))
    assert hits >= 0.9 * 10 * len(asked)


def test_lists_with_few_vectors():
    """The nearest lists of a query may hold nothing."""
    random = np.random.RandomState(3)
    shared = type("Shared", (), {"value": ann.Graph(random.normal(size=(200, 4)))})
    sizes = np.zeros(200, int)
    sizes[150:] = 10
    out = pd.concat(ann._probed(shared, sizes, 10)([pd.DataFrame({"id": [1], "v": [random.normal(size=4)]})]))
    assert sizes[out["list"]].sum() >= 88


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark):
    rows = [(1, [2.0, 0.0]), (1, [3.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [5.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(vectors, vectors.filter("vec_id % 100 = 0"), k=5).collect())
    want = []
    for n, (i, v) in enumerate(rows):
        if i == 100:
            near = sorted((abs(w[0] - v[0]), j) for k, (j, w) in enumerate(rows) if k != n)[:5]
            want += [(100, rank, j, d) for rank, (d, j) in enumerate(near, 1)]
    assert got == sorted(want)
    # a query that isn't a row of the table leaves none out
    other = spark.createDataFrame([(7, [1.5, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in sorted(ann.search(vectors, other, k=3).collect(), key=lambda r: r.rank)] == [1, 7, 7]


def test_centroids_of_clusters_far_apart_are_found():
    random = np.random.RandomState(4)
    c = (random.normal(size=(60, 1, 16)) * 10 + random.normal(size=(60, 30, 16)) * 0.1).reshape(-1, 16)
    graph = ann.Graph(c)
    for q in c[::37] + random.normal(size=16) * 0.05:
        d = np.sqrt(((c - q) ** 2).sum(axis=1))
        assert graph.nearest(q, 24)[0].tolist() == np.argsort(d, kind="stable")[:24].tolist()


def test_neighbours_far_from_zero_and_the_ratio_of_data_without_clusters():
    random = np.random.RandomState(5)
    x = random.normal(size=(500, 8)) + 1e9
    x[::2] += 1e9
    queries = pd.DataFrame({"query": [0], "asker": [0], "own": [0], "q": [x[0]]})
    got = ann._compared(10)(queries, pd.DataFrame({"row": range(500), "id": range(500), "v": list(x)}))
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    assert got["id"].tolist() == [i for i in np.lexsort((np.arange(500), d)) if i][:10]
    plain = random.normal(size=(20_000, 32))
    assert ann.probe_ratio(ann.Graph(ann.balanced_centroids(plain, 1000)), plain, 10) > ann.PROBE_RATIO
