"""Approximate nearest neighbours by balanced posting lists (after SPANN: Chen et al., 2021).

Of equal vectors only the k + 1 rows of the smallest ids go on: they are equally far from any query, ties go by the smaller
id, and only a query's own row is left out, so no other of them can be among the k nearest. Centroids are learned by balanced
k-means from the distinct vectors of a bounded sample (about ``SAMPLE`` vectors, by their hash; at most ``MOST_LISTS`` centroids, no two equal). Every
vector goes to the list of its nearest centroid and, where it lies near a boundary, to those of further ones whose distance
is within a ratio of the least. A query finds the centroids near it by a best-first search of two levels that is
held in memory and misses none: the ``PROBES`` nearest at least, and all whose distance is within a ratio of the least, however many these are (in
clustered data few, where distances hardly differ many). The ratio is measured: with it, ``FOUND`` of the true neighbours of vectors of the sample lie in lists that are
searched. A query is compared with all vectors of their lists. While these hold too few vectors, further lists are added, all of them if need be.

The centroids and the sizes of the lists are bounded by ``MOST_LISTS`` and sent to all executors. Lists and their queries
are dealt out in blocks of bounded size, so that a list of any size takes bounded memory in a task; every block of a list
meets every block of its queries. Distances are Euclidean, of the original vectors in double precision.

Vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part. A query's own
row is one row with its id and its very vector; rows that repeat an id are rows of their own, as candidates (of that query too) and as
queries. Equal distances go by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampwise.llm.common import written

#: About how many vectors centroids are learned from, the most centroids, and the vectors a list should have.
SAMPLE, MOST_LISTS, LIST_SIZE = 40_000, 8192, 256
#: The most lists of a vector, and the distance ratio to its nearest centroid within which it is replicated.
COPIES, COPY_RATIO = 4, 1.15
#: The fewest lists of a query, and the distance ratio within which all lists are searched.
PROBES, PROBE_RATIO = 24, 1.12
#: Vectors of the sample whose neighbours in it set the ratio for other data, and the share of these neighbours that must be found.
TRIED, FOUND = 256, 0.85
#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Rows of (list, query) that leave a task at a time.
PROBE_ROWS = 20_000


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y, fast and nearly exact; taken about the mean of y, so that vectors far from zero keep their digits."""
    mean = y.mean(axis=0)
    x, y = x - mean, y - mean
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def beyond(limit: float, q: np.ndarray, x: np.ndarray) -> float:
    """A squared distance from ``q`` that no row of ``x`` of a true squared distance up to ``limit`` exceeds in ``distances``, whatever its rounding errors."""
    eps, mean = np.finfo(float).eps, x.mean(axis=0)
    inner = 4 * (x.shape[1] + 2) * eps * (((q - mean) ** 2).sum() + ((x - mean) ** 2).sum(axis=1).max())
    moved = 2 * eps * np.sqrt(x.shape[1]) * (np.abs(x).max() + np.abs(q).max())
    return (np.sqrt(limit + inner) + 2 * moved) ** 2 + inner


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means of distinct vectors, whose smallest cells are given to the halves of the largest ones after each round.

    Centroids that are nearest to no vector, as all but one of equal ones, are left out.
    """
    nearest = lambda c: np.concatenate([distances(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)])
    random = np.random.RandomState(seed)
    c = x[random.choice(len(x), k, replace=False)].astype(np.float64)
    for step in range(rounds):
        near = nearest(c)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if step < rounds - 2:
            order = np.argsort(size, kind="stable")
            for small, large in zip(order, order[::-1], strict=True):
                if size[large] <= 3 * len(x) / k or size[small] >= 0.3 * len(x) / k:
                    break
                own = x[near == large]
                c[small] = own[random.randint(len(own))]
    c = np.unique(c, axis=0)
    return c[np.unique(nearest(c))]


class Graph:
    """Centroids below hubs: about the square root of their number, each as far as can be from those before it. A centroid hangs on its nearest hub.

    Hubs are opened best-first, by the least distance that one of their centroids can have. The search ends when no closed hub can hold a centroid that is wanted,
    so that it finds all of them, however far apart clusters lie.
    """

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        measure = lambda i: np.sqrt(((centroids - centroids[i]) ** 2).sum(axis=1))
        hubs, of, far = [0], np.zeros(len(centroids), int), measure(0)
        while len(hubs) ** 2 < len(centroids) and far.max() > 0:
            hubs.append(int(far.argmax()))
            d = measure(hubs[-1])
            of, far = np.where(d < far, len(hubs) - 1, of), np.minimum(far, d)
        self.hubs = centroids[hubs]
        self.below = [np.flatnonzero(of == h) for h in range(len(hubs))]
        self.radius = np.array([far[b].max() for b in self.below])

    def nearest(self, q: np.ndarray, n: int, ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and distances of the n nearest centroids, and of all others within ``ratio`` of the least distance, nearest first."""
        bound = np.sqrt(((self.hubs - q) ** 2).sum(axis=1)) - self.radius
        at, d, limit = np.zeros(0, int), np.zeros(0), np.inf
        for h in np.argsort(bound, kind="stable"):
            if bound[h] > limit * (1 + 1e-9):
                break
            at = np.r_[at, self.below[h]]
            d = np.r_[d, np.sqrt(((self.c[self.below[h]] - q) ** 2).sum(axis=1))]
            if len(d) >= n:
                limit = max(np.partition(d, n - 1)[n - 1], ratio * d.min())
        order = np.argsort(d, kind="stable")
        order = order[: max(n, int((d <= ratio * d.min()).sum()))]
        return at[order], d[order]


def probe_ratio(graph: Graph, x: np.ndarray, k: int, seed: int = 3) -> float:
    """The distance ratio within which ``FOUND`` of the nearest neighbours of vectors of the sample ``x``, by brute force, lie in lists that are searched; at least ``PROBE_RATIO``.

    In the whole table neighbours are nearer than in a sample, so that fewer are missed there.
    """
    at = np.random.RandomState(seed).permutation(len(x))[:TRIED]
    k = min(k, len(x) - 1)
    if k < 1:
        return PROBE_RATIO
    needed = []
    for i in at:
        d = distances(x[i : i + 1], x)[0]
        d[i] = np.inf
        near = np.argpartition(d, k - 1)[:k]
        lists = distances(x[near], graph.c).argmin(axis=1)
        to = np.sqrt(((graph.c - x[i]) ** 2).sum(axis=1))
        rank = np.searchsorted(np.sort(to), to[lists])
        needed.append(np.where((rank < PROBES) | (to.min() == 0), 0.0, to[lists] / max(to.min(), 1e-300)))
    return max(PROBE_RATIO, float(np.quantile(np.concatenate(needed), FOUND, method="higher")))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of doubles."""
    v = F.col("v")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.filter(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    most = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return own.filter(F.size("v") == (most[0] if most else 0))


def fewest(own: DataFrame, k: int) -> DataFrame:
    """(row, id, v, nth): the ``k + 1`` rows of the smallest ids of each vector, numbered among the rows of equal id and vector. Each partition leaves out its own others before rows are shuffled."""
    equal = Window.partitionBy("h", "v").orderBy("id", "row")
    own = own.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("v")).withColumn("of_vector", F.row_number().over(equal))
    return own.filter(F.col("of_vector") <= k + 1).select("row", "id", "v", F.row_number().over(Window.partitionBy("h", "v", "id").orderBy("row")).alias("nth"))


def asking(queries: DataFrame, own: DataFrame) -> DataFrame:
    """(query, id, v, own): queries with a number of each, and the row of ``own`` that is the query itself (-1 if none is)."""
    there = own.select(F.col("id").alias("i"), F.xxhash64("v").alias("h"), F.col("v").alias("w"), F.col("nth").alias("n"), F.col("row").alias("own"))
    asked = queries.withColumn("query", F.monotonically_increasing_id()).withColumn("hq", F.xxhash64("v"))
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("hq", "v", "id").orderBy("query")))
    same = (F.col("i") == F.col("id")) & (F.col("h") == F.col("hq")) & (F.col("w") == F.col("v")) & (F.col("n") == F.col("nth"))
    return asked.join(there, same, "left").select("query", "id", F.coalesce("own", F.lit(-1).cast("long")).alias("own"), "v")


def _posted(shared):
    def run(frames):
        graph = shared.value
        for pdf in frames:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, graph.c.shape[1]))
            for i in range(0, len(x), 2048):
                d = np.sqrt(distances(x[i : i + 2048], graph.c))
                near = np.argpartition(d, min(COPIES, d.shape[1]) - 1, axis=1)[:, :COPIES]
                own = np.take_along_axis(d, near, axis=1)
                row, col = np.nonzero(own <= own.min(axis=1)[:, None] * COPY_RATIO)
                yield pd.DataFrame({"list": near[row, col], "row": pdf["row"].to_numpy()[i + row], "id": pdf["id"].to_numpy()[i + row], "v": list(x[i + row])})

    return run


def _probed(shared, sizes: np.ndarray, k: int, ratio: float = PROBE_RATIO):
    def run(frames):
        graph = shared.value
        for pdf in frames:
            others = pdf.drop(columns="v")
            rows, names = [], ["list", *others.columns, "q"]
            for own, v in zip(others.itertuples(index=False), pdf["v"], strict=True):
                near, d = graph.nearest(np.asarray(v), PROBES, ratio)
                if sizes[near].sum() < 8 * (k + 1) and len(near) < len(sizes):
                    d = np.sqrt(((graph.c - np.asarray(v)) ** 2).sum(axis=1))
                    near = np.argsort(d, kind="stable")
                    held = np.cumsum(sizes[near])
                    near = near[: max(PROBES, int(np.searchsorted(held, 8 * (k + 1))) + 1)]
                    d = d[near]
                rows += [(int(c), *own, v) for c in near]
                if len(rows) >= PROBE_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return run


def _compared(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            x, ids, rows = np.stack(vectors["v"].to_numpy()), vectors["id"].to_numpy(), vectors["row"].to_numpy()
            rough = np.stack(queries["q"].to_numpy())
            for query, asker, own, q, d in zip(queries["query"], queries["asker"], queries["own"], rough, distances(rough, x), strict=True):
                d[rows == own] = np.inf
                limit = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                near = np.flatnonzero(d <= beyond(limit, q, x)) if np.isfinite(limit) else np.flatnonzero(np.isfinite(d))
                exact = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
                best = np.lexsort((rows[near], ids[near], exact))[:k]
                out += zip([query] * len(best), [asker] * len(best), rows[near[best]].tolist(), ids[near[best]].tolist(), exact[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query", "asker", "row", "id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found vectors of each query, both tables with an id and a vector."""
    spark = vectors.sparkSession
    own = written(fewest(usable(vectors, id_col, vector_col), k), "ann-vectors")
    n = own.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least = F.lit(SAMPLE / n * 2.0**64 - 2.0**63)  # about SAMPLE rows, without a sort
    sample = own.filter(F.xxhash64("id", "v") <= least).select("v") if n > SAMPLE else own.select("v")
    x = np.unique(np.array([r[0] for r in sample.collect()]), axis=0)
    graph = Graph(balanced_centroids(x, int(min(max(1, n // LIST_SIZE), MOST_LISTS, max(1, len(x) // 4)))))
    shared = spark.sparkContext.broadcast(graph)
    posted = written(own.mapInPandas(_posted(shared), "list int, row long, id long, v array<double>"), "ann-lists")
    count = dict(posted.groupBy("list").count().collect())
    sizes = np.array([count.get(i, 0) for i in range(len(graph.c))])
    asked = written(asking(usable(queries, id_col, vector_col).filter(F.size("v") == x.shape[1]), own), "ann-queries")
    probed = written(asked.mapInPandas(_probed(shared, sizes, k, probe_ratio(graph, x, k)), "list int, query long, id long, own long, q array<double>"), "ann-probes")
    wanted = dict(probed.groupBy("list").count().collect())
    blocks = F.broadcast(spark.createDataFrame([(i, -(-count[i] // BLOCK), -(-wanted[i] // QUERY_BLOCK)) for i in count if i in wanted], "list int, parts long, query_parts long"))
    left = probed.join(blocks, "list").select("list", F.pmod(F.xxhash64("query"), "query_parts").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("vb"), "query", F.col("id").alias("asker"), "own", "q")
    right = posted.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts") - 1)).alias("qb"), F.pmod(F.xxhash64("row"), "parts").alias("vb"), "row", "id", "v")
    key = ["list", "qb", "vb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_compared(k), "query long, asker long, row long, id long, score double").groupBy("query", "asker", "row", "id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "id", "row"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("asker").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
