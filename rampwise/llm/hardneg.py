"""Hard negatives by a search over candidates in buckets of like norm.

Candidates are sorted by the norm of their whole-number vectors, largest first, and cut into buckets of bounded size, each packed in one row. By
the inequality of Cauchy and Schwarz no score in a bucket exceeds the anchor's norm times the bucket's largest one, so a bucket
is left out where that bound lies below the lower limit of the score window, or below the score of rank k found so far.

A demand is an anchor with a window of scores and the wish for rows of its own label (its positives) or of other labels (the
negatives of one positive). Demands are dealt out in blocks of an anchor's hash, buckets in groups of consecutive ones. The first
group, of the largest norms, is searched first; the scores of rank k from it are the limits with which the pairs of
block and group are made, and within a pair the limits go on falling in from bucket to bucket. Each pair is one task's work
of bounded size. The directory of buckets has at most ``MOST_BUCKETS`` rows, and as many more as there are
partitions, since buckets grow with the table beyond that.

Scores are exact: products of whole numbers in double precision where no sum can reach 2^53, in Python's integers
otherwise (they have to fit 64 bits in the end). Higher scores come first, ties by the smaller id. Rows with a null
id, label or vector, with null or non-finite components, or of another length than most take no part; zero vectors do. Rows
that repeat an id are rows of their own: other rows than the anchor, and anchors each. Empty tables give empty ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.llm.common import column, written

#: Rows of a bucket, the most buckets of a table, the rows of a group of buckets, and the demands of a block.
BUCKET, MOST_BUCKETS, GROUP, BLOCK = 1024, 1 << 16, 4096, 2048
EXACT = 2.0**52


def _quantised(scale: float):
    def run(frames):
        for pdf in frames:
            if len(pdf):
                x = np.floor(scale * np.array(pdf.pop("v").tolist(), np.float64))
                yield pdf.assign(v=[r.tobytes() for r in x], norm=np.sqrt((x * x).sum(axis=1)))

    return run


def usable(vectors: DataFrame, anchor: Column, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(row, id, label, anchor, v, norm): the rows that take part, each with a number of its own."""
    own = vectors.select(column(id_col).cast("long").alias("id"), column(label_col).cast("long").alias("label"), anchor.alias("anchor"), column(vector_col).cast("array<double>").alias("v"))
    own = own.filter("id is not null and label is not null and v is not null").filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    own = own.filter(F.size("v") == (most[0] if most else 0)).select(F.monotonically_increasing_id().alias("row"), "id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), "v")
    return written(own.mapInPandas(_quantised(scale), "row long, id long, label long, anchor boolean, v binary, norm double"), "negatives-rows")


def _packed(size: int):
    """Rows, which come in the order of their norms, as buckets of ``size``."""

    def bucket(pdf: pd.DataFrame, nth: int) -> tuple:
        number = (TaskContext.get().partitionId() << 32) + nth
        return (number, float(pdf["norm"].max()), len(pdf), *(pdf[c].to_numpy(np.int64).tobytes() for c in ("row", "id", "label")), b"".join(pdf["v"]))

    def run(frames):
        held, nth, names = None, 0, ["bucket", "norm", "n", "rows", "ids", "labels", "v"]
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            whole = len(held) // size * size
            for i in range(0, whole, size):
                yield pd.DataFrame([bucket(held.iloc[i : i + size], nth)], columns=names)
                nth += 1
            held = held.iloc[whole:]
        if held is not None and len(held):
            yield pd.DataFrame([bucket(held, nth)], columns=names)

    return run


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of x and y, whole numbers held as doubles."""
    most = lambda a: np.sqrt((a * a).sum(axis=1).max())
    if most(x) * most(y) < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = lambda a: np.array([[int(c) for c in r] for r in a.tolist()], object)
    return (whole(x) @ whole(y).T).astype(np.int64)


def _vectors(packed, n: int) -> np.ndarray:
    return np.frombuffer(packed if isinstance(packed, bytes) else b"".join(packed), np.float64).reshape(n, -1)


def _searched(k: int, same: bool):
    """The first ``k`` rows of each demand of a block in a group of buckets."""

    def run(asked: pd.DataFrame, buckets: pd.DataFrame) -> pd.DataFrame:
        names = ["demand", "found", "id", "score"]
        if not len(asked) or not len(buckets):
            return pd.DataFrame([], columns=names)
        _, first, which = np.unique(asked["anchor"].to_numpy(), return_index=True, return_inverse=True)
        x = _vectors(asked["v"].iloc[first], len(first))
        norm, lo, hi, least, label, row = (asked[c].to_numpy() for c in ("norm", "lo", "hi", "least", "label", "anchor"))
        limit = np.maximum(lo, least)
        best: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3] * len(asked)
        for b in buckets.sort_values(["norm", "bucket"], ascending=[False, True]).itertuples():
            open_ = np.flatnonzero(norm * b.norm * (1 + 1e-9) + 1e-9 >= limit)
            if not len(open_):
                break
            rows, ids, labels = (np.frombuffer(c, np.int64) for c in (b.rows, b.ids, b.labels))
            own, at = np.unique(which[open_], return_inverse=True)
            score = products(x[own], _vectors(b.v, b.n))
            for d, i in zip(open_.tolist(), at.tolist(), strict=True):
                s = score[i]
                good = np.flatnonzero((s >= limit[d]) & (s <= hi[d]) & ((labels == label[d]) == same) & (rows != row[d]))
                if not len(good):
                    continue
                if len(good) > k:
                    kth = np.partition(s[good], len(good) - k)[len(good) - k]
                    good = good[s[good] >= kth]
                s, i_, r = (np.concatenate(p) for p in zip(best[d], (s[good], ids[good], rows[good]), strict=True))
                order = np.lexsort((r, i_, -s))[:k]
                best[d] = s[order], i_[order], r[order]
                if len(order) == k:
                    limit[d] = max(limit[d], best[d][0][-1])
        out = [pd.DataFrame({"demand": d, "found": r, "id": i, "score": s}) for d, (s, i, r) in zip(asked["demand"].tolist(), best, strict=True) if len(s)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame([], columns=names)

    return run


def _alive(groups: list[tuple[int, float]]):
    """The groups that a demand's limits allow, of those whose number and largest norm are given."""
    number, norm = np.array([g for g, _ in groups], np.int64), np.array([x for _, x in groups])

    def run(frames):
        for pdf in frames:
            out = []
            for block, own in pdf.groupby("block"):
                limit = np.maximum(own["lo"], own["least"]).to_numpy()
                some = [(block, g) for g, x in zip(number.tolist(), norm.tolist(), strict=True) if (own["norm"].to_numpy() * x * (1 + 1e-9) + 1e-9 >= limit).any()]
                out += some
            yield pd.DataFrame(out, columns=["block", "grp"])

    return run


def first_rows(demands: DataFrame, buckets: DataFrame, directory: list[tuple[int, float, int]], k: int, same: bool) -> DataFrame:
    """(demand, found, id, score, rank): the first ``k`` rows of every demand (demand, anchor, label, v, norm, lo, hi).

    ``directory``: (bucket, norm, n), largest norms first.
    """
    spark = demands.sparkSession
    before = np.cumsum([0, *(n for _, _, n in directory)])
    grouped = [(b, x, int(i // GROUP)) for (b, x, _), i in zip(directory, before, strict=False)]
    tops: dict[int, float] = {}
    for _, x, g in grouped:
        tops[g] = max(tops.get(g, 0.0), x)
    members = F.broadcast(spark.createDataFrame([(b, g) for b, _, g in grouped], "bucket long, grp long"))
    placed = buckets.join(members, "bucket")
    blocks = max(1, -(-demands.count() // BLOCK))
    asked = demands.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))

    def found(asked: DataFrame, groups: list[tuple[int, float]], name: str) -> DataFrame:
        pairs = written(asked.select("block", "norm", "lo", "least").mapInPandas(_alive(groups), "block long, grp long").distinct(), f"negatives-{name}-pairs")
        left, right = asked.join(pairs, "block").groupBy("block", "grp"), placed.join(pairs, "grp").groupBy("block", "grp")
        return written(left.cogroup(right).applyInPandas(lambda x, y: _searched(k, same)(x, y), "demand long, found long, id long, score long"), f"negatives-{name}")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("demand").orderBy(F.desc("score"), "id", "found"))).filter(F.col("rank") <= k)

    lowest = F.lit(-(2**63)).cast("long")
    head = found(asked.withColumn("least", lowest), [(0, tops[0])], "head")
    rest = [(g, x) for g, x in tops.items() if g]
    if not rest:
        return ranked(head)
    limits = ranked(head).groupBy("demand").agg(F.max("rank").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).select("demand", "kth")
    tail = found(asked.join(limits, "demand", "left").withColumn("least", F.coalesce("kth", lowest)).drop("kth"), rest, "tail")
    return ranked(head.union(tail))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row where ``anchor`` holds, its ``positives`` first other rows of the same label; for each of these, the ``negatives`` first
    rows of other labels whose score is from ``low`` to ``high`` per cent of the positive's. Components are floor(scale * x).
    """
    spark = vectors.sparkSession
    own = usable(vectors, anchor, scale, id_col, label_col, vector_col)
    n = own.count()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return empty
    size = max(BUCKET, -(-n // MOST_BUCKETS))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // size)))
    packed = own.repartitionByRange(parts, F.desc("norm"), "id", "row").sortWithinPartitions(F.desc("norm"), "id", "row").mapInPandas(_packed(size), "bucket long, norm double, n long, rows binary, ids binary, labels binary, v binary")
    buckets = written(packed, "negatives-buckets")
    directory = sorted(map(tuple, buckets.select("bucket", "norm", "n").collect()), key=lambda b: (-b[1], b[0]))
    anchors = own.filter("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "label", "v", "norm")
    whole = [F.lit(x).cast("long").alias(c) for x, c in ((-(2**63), "lo"), (2**63 - 1, "hi"))]
    got = first_rows(anchors.select(F.col("anchor").alias("demand"), "anchor", "label", "v", "norm", *whole), buckets, directory, positives, same=True)
    pairs = got.select(F.col("demand").alias("anchor"), F.col("found").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda percent, more: F.expr(f"positive_score div 100 * {percent} + (positive_score % 100 * {percent} + {more}) div 100")
    # a negative score makes the window empty: its lower limit is the larger one
    pairs = pairs.filter("positive_score >= 0").select(F.monotonically_increasing_id().alias("demand"), "*", share(low, 99).alias("lo"), share(high, 0).alias("hi"))
    pairs = written(pairs.join(anchors, "anchor"), "negatives-demands")
    got = first_rows(pairs.select("demand", "anchor", "label", "v", "norm", "lo", "hi"), buckets, directory, negatives, same=False)
    return got.join(pairs.select("demand", "anchor_id", "positive_id", "positive_score"), "demand").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
