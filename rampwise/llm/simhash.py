"""Near-duplicate documents by SimHash fingerprints and a hierarchical index in Gray order.

1. A fingerprint has bit i set where over half the XXH64 values of a document's word shingles (repeats included) have it. Documents of
   equal fingerprints are one node (the smallest doc_id of them).
2. The distinct fingerprints are sorted by their rank in the Gray code and cut into shards of consecutive ones, each packed in
   one row. Neighbours in this order differ in few bits, so a shard, and every group in it, shares many.
3. The bits that all of a shard's fingerprints share are its masked pattern. Two shards whose patterns differ in more than ``most``
   bits are never compared; the table of patterns has at most ``MOST_SHARDS`` rows (and as many more as there are partitions), since shards grow with
   the table beyond that, and is sent to all executors. Every other pair of shards, a shard with itself too, is one task's work.
4. In a task one shard's index is a tree of groups of ``FAN``: each node holds the shared bits that its parent lacks. The other
   shard's fingerprints go down the tree; differences add up on the way, and a whole group is left as soon as they exceed ``most``, or
   when all of it is already connected with the fingerprint. Runs of neighbours in the merged order that are close to each other are
   connected from the start. A task keeps links only that connect what wasn't connected, so that a large group of near copies
   gives as many links as it has members and not as many as it has pairs.
5. Links are joined to components.

Null and empty texts, and those without words, have the fingerprint zero, which links like any other. Rows without a doc_id have a fingerprint,
are linked with nothing and have no component. Rows that share a doc_id are one document: it has the links of each of
them. Other columns, of any name, play no part. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import id_text, ragged, written
from rampwise.llm.graph import components

#: Fingerprints of a shard: at least, at most while there are few enough shards, and into how many parts a table of medium size goes.
LEAST_SHARD, MOST_SHARD, PARTS, MOST_SHARDS = 2048, 1 << 19, 24, 1 << 16
#: Members of a group in the tree, fingerprints that go down at a time, and comparisons at a time.
FAN, ASKED, STEPS = 8, 1024, 1 << 20
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of the shingles of ``words`` words (the whole sequence, if it has fewer), A-Z lower-cased."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    n = min(words, len(found))
    joined = b" ".join(found)
    stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    begins, ends = np.r_[0, stops[:-1]][: len(found) - n + 1], stops[n - 1 :] - 1
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(begins), COUNTED):
        own = np.array([h(joined[a:b], seed) for a, b in zip(begins[i : i + COUNTED].tolist(), ends[i : i + COUNTED].tolist(), strict=True)], "<u8")
        total += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(begins), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(frames):
        for pdf in frames:
            found = np.array([fingerprint(t, words, seed) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fingerprint": found.astype(np.int64)})

    return run


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit number) for every row of ``docs``."""
    return id_text(docs, id_col, text_col).mapInPandas(_fingerprints(words, seed), "doc_id long, fingerprint long")


def gray_rank(fingerprint: Column | str) -> Column:
    """The place of a 64-bit number in the order of the Gray code, shifted so that signed numbers sort by it."""
    x = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def ranked(x: np.ndarray) -> np.ndarray:
    """Places of unsigned 64-bit numbers in the order of the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def shared(x: np.ndarray) -> tuple[int, int]:
    """The mask of the bits in which all numbers agree, and their values there."""
    mask = ~(np.bitwise_or.reduce(x) ^ np.bitwise_and.reduce(x))
    return int(mask), int(x[0] & mask)


def _sharded(size: int):
    """Rows, which come in Gray order, as shards of ``size``."""

    def shard(pdf: pd.DataFrame, nth: int) -> tuple:
        x = pdf["fingerprint"].to_numpy(np.int64)
        mask, value = (np.array([v], np.uint64).astype(np.int64)[0] for v in shared(x.view(np.uint64)))
        return ((TaskContext.get().partitionId() << 32) + nth, mask, value, x.tobytes(), pdf["node"].to_numpy(np.int64).tobytes())

    def run(frames):
        held, nth, names = None, 0, ["shard", "mask", "value", "own", "nodes"]
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            whole = len(held) // size * size
            for i in range(0, whole, size):
                yield pd.DataFrame([shard(held.iloc[i : i + size], nth)], columns=names)
                nth += 1
            held = held.iloc[whole:]
        if held is not None and len(held):
            yield pd.DataFrame([shard(held, nth)], columns=names)

    return run


def _met(patterns, most: int):
    """A row of each shard for each pair that it is part of."""

    def run(frames):
        number, mask, value = patterns.value
        for pdf in frames:
            for r in pdf.itertuples():
                m, v = (np.array([c], np.int64).view(np.uint64)[0] for c in (r.mask, r.value))
                near = number[np.bitwise_count((value ^ v) & mask & m) <= most]
                for a, b in zip(np.minimum(near, r.shard).tolist(), np.maximum(near, r.shard).tolist(), strict=True):
                    yield pd.DataFrame({"x": [a], "y": [b], "shard": [r.shard], "own": [r.own], "nodes": [r.nodes]})

    return run


class Tree:
    """Fingerprints in Gray order under groups of ``FAN``; a node has the shared bits that its parent lacks."""

    def __init__(self, x: np.ndarray):
        masks, values = [np.full(len(x), np.iinfo(np.uint64).max, np.uint64)], [x]
        while len(values[-1]) > 1:
            heads = np.arange(0, len(values[-1]), FAN)
            first = np.repeat(values[-1][heads], np.diff(np.r_[heads, len(values[-1])]))
            alike = masks[-1] & ~(values[-1] ^ first)
            masks.append(np.bitwise_and.reduceat(alike, heads))
            values.append(values[-1][heads] & masks[-1])
        for k in range(len(masks) - 1):
            masks[k] = masks[k] & ~np.repeat(masks[k + 1], FAN)[: len(masks[k])]
        self.masks, self.values = masks, [v & m for v, m in zip(values, masks, strict=True)]

    def marked(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level the label that all of a node's members have, -1 where they differ."""
        out = [labels]
        for _ in self.masks[1:]:
            heads = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], heads), np.maximum.reduceat(out[-1], heads)
            out.append(np.where(low == high, low, -1))
        return out


def _merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The labels after the links (a, b) between them, and which of these connected what wasn't."""
    root = np.arange(labels.max() + 1 if len(labels) else 0)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    used = []
    _, distinct = np.unique(a * (len(root) + 1) + b, return_index=True)
    for k, u, v in zip(distinct.tolist(), a[distinct].tolist(), b[distinct].tolist(), strict=True):
        u, v = top(u), top(v)
        if u != v:
            root[max(u, v)] = min(u, v)
            used.append(k)
    for x in np.flatnonzero(root != np.arange(len(root))).tolist():
        root[x] = top(x)
    return root[labels], used


def close_links(x: np.ndarray, y: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect what is connected by differences of at most ``most`` bits.

    Between x and y, given that each of them is connected in itself by other links; within x, if y is None. x and y are in Gray order.
    """
    n, alone = len(x), y is None
    both = x if alone else np.r_[x, y]
    order = np.argsort(ranked(both), kind="stable")
    near = np.bitwise_count(both[order[1:]] ^ both[order[:-1]]) <= most
    labels = np.empty(len(both), np.int64)
    labels[order] = np.cumsum(np.r_[0, ~near])
    i, j = np.minimum(order[1:], order[:-1])[near], np.maximum(order[1:], order[:-1])[near]
    kept = np.ones(len(i), bool) if alone else (i < n) & (j >= n)
    left, right = [i[kept]], [j[kept]]
    tree, shift = Tree(x if alone else y), 0 if alone else n
    depth = len(tree.masks) - 1
    span = [FAN**k for k in range(depth + 1)]
    for at in range(0, n, ASKED):
        asked = np.arange(at, min(n, at + ASKED))
        mark = tree.marked(labels[shift:])
        some = asked[mark[depth][0] != labels[asked]] if mark[depth][0] >= 0 else asked
        open_ = [(depth, some, np.zeros(len(some), np.int64), np.bitwise_count((x[some] ^ tree.values[depth][0]) & tree.masks[depth][0]).astype(np.int64))]
        while open_:
            level, q, node, d = open_.pop()
            good = (d <= most) & (mark[level][node] != labels[q])
            if alone:
                good &= (node + 1) * span[level] - 1 > q
            q, node, d = q[good], node[good], d[good]
            if not len(q):
                continue
            if level == 0:
                a, b = labels[q], labels[node + shift]
                labels, used = _merged(labels, a, b)
                if used:
                    left.append(q[used])
                    right.append(node[used] + shift)
                    mark = tree.marked(labels[shift:])
                continue
            if len(q) * FAN > STEPS and len(q) > 1:
                half = len(q) // 2
                open_ += [(level, q[:half], node[:half], d[:half]), (level, q[half:], node[half:], d[half:])]
                continue
            below = len(tree.masks[level - 1])
            count = np.minimum(FAN, below - node * FAN)
            child, asks = ragged(node * FAN, count), np.repeat(q, count)
            more = np.bitwise_count((x[asks] ^ tree.values[level - 1][child]) & tree.masks[level - 1][child])
            open_.append((level - 1, asks, child, np.repeat(d, count) + more))
    return np.concatenate(left), np.concatenate(right)


def _linked(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        own = [np.frombuffer(b, np.uint64) for b in pdf["own"]]
        nodes = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["nodes"]])
        i, j = close_links(own[0], own[1] if len(own) > 1 else None, most)
        return pd.DataFrame({"a": nodes[i], "b": nodes[j]})

    return run


def links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links that connect all nodes (fingerprint, node) with distinct fingerprints of at most ``most`` differing bits, over any number of links."""
    spark = nodes.sparkSession
    n = nodes.count()
    size = max(LEAST_SHARD, min(MOST_SHARD, n // PARTS), -(-n // MOST_SHARDS))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // size)))
    order = gray_rank("fingerprint")
    packed = nodes.withColumn("rank", order).repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("fingerprint", "node")
    shards = written(packed.mapInPandas(_sharded(size), "shard long, mask long, value long, own binary, nodes binary"), "simhash-shards")
    patterns = np.array([tuple(r) for r in shards.select("shard", "mask", "value").collect()], np.int64).reshape(-1, 3)
    sent = spark.sparkContext.broadcast((patterns[:, 0].copy(), patterns[:, 1].copy().view(np.uint64), patterns[:, 2].copy().view(np.uint64)))
    met = shards.mapInPandas(_met(sent, most), "x long, y long, shard long, own binary, nodes binary")
    return met.groupBy("x", "y").applyInPandas(_linked(most), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; the fingerprint as a signed 64-bit number."""
    own = written(fingerprints(docs, words, seed, id_col, text_col), "simhash")
    some = own.filter("doc_id is not null")
    nodes = written(some.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # rows of one id whose fingerprints belong to different nodes tie these nodes together
    several = some.groupBy("doc_id").agg(F.min("fingerprint").alias("least"), F.max("fingerprint").alias("other")).filter("least < other").select("doc_id")
    owners = some.join(several, "doc_id").join(nodes, "fingerprint").select("doc_id", "node").distinct()
    ties = owners.join(owners.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("node").alias("b")).filter("a <> b")
    parts = written(components(written(links(nodes, most), "simhash-links").union(ties)), "simhash-parts")
    named = written(nodes.join(parts, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component")), "simhash-named")
    got = own.join(named, "fingerprint", "left")
    return got.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.least("component", "doc_id")).alias("component_id"))
