"""Near-duplicate documents by an inverted join of MinHash coordinates, each link confirmed on the full shingle sets.

1. A document's set of word shingles gets a MinHash signature of ``coordinates`` values and a bitmap of ``BITS`` parities;
   documents of equal sets are one node (the smallest doc_id of them).
2. Two sets of Jaccard similarity s agree in each coordinate with probability s. Pairs that agree in ``least`` coordinates
   are candidates. All coordinate values are put in one order, rarer ones first (by their counts in a table of ``CELLS``
   cells; any order gives the same result); two such signatures agree in at least one of the first
   ``coordinates - least + 1`` values of each. Only this prefix is posted under (value, band of set sizes, own and next);
   the frequent values are skipped in the postings and counted when postings are merged. At similarity 0.8, 64 coordinates
   and a threshold of 36 miss a pair with a probability of about 4.2e-6.
3. Within a posting list every document is paired with the list's smallest and largest node only, not with all others.
   Pairs above the threshold are confirmed on their full sets, and links joined to components.
4. The posting lists that, but for these two, still hold several components are merged inside the tasks: what isn't in a list's largest component
   is a query against the list, both in blocks of bounded size. Collisions are counted on the signatures, each pair in the
   list of its first common posting only, and a pair leaves the task only if it reaches the threshold and its bitmaps allow
   the similarity: the bits in which two bitmaps of parities differ are at most the shingles that only one of the sets
   has, so that this filter loses nothing. So no link between two components is lost, and pairs that merely resemble each
   other make no rows.
5. New links are confirmed and joined to the components.

Null texts, empty texts and texts without words have no shingles and are linked with nothing. Rows without a doc_id are
linked with nothing and kept. Rows that share a doc_id are one document: it has the links of each of them, they get one
component, and all or none of them are kept. Other columns, of any name, play no part.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import column, id_text, ragged, unused, written
from rampwise.llm.graph import components

COORDINATES, LEAST = 64, 36
#: Cells of the table of counts by which values are ordered, and its slices in the shuffle.
CELLS, SLICES = 1 << 20, 64
#: Parities in a document's bitmap.
BITS = 1024
#: Queries and documents of a posting list that meet in one task, and the pairs compared at a time.
QUERY_BLOCK, BLOCK, PAIRS = 512, 4096, 1 << 15
#: What a posting is in a block.
QUERY, BOTH, DOCUMENT = 0, 1, 2

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.array([c in b"\x20\x09\x0a\x0b\x0c\x0d" for c in range(256)])
_RANDOM = np.random.RandomState(20240117)
_BYTE = _RANDOM.randint(1, 1 << 62, 256).astype(np.uint64)
_FACTORS = (_RANDOM.randint(1, 1 << 62, 256).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADDED = _RANDOM.randint(1, 1 << 62, 256).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words (between spaces and the bytes 09-0D) of a text, A-Z lower-cased."""
    return words_at(text)[0]


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes``, and where each word begins."""
    b = np.frombuffer(text.translate(_LOWER), np.uint8)
    at = np.flatnonzero(~_SPACE[b])
    if not len(at):
        return np.zeros(0, np.uint64), at
    head = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    length = np.diff(np.r_[head, len(at)])
    place = np.arange(len(at)) - np.repeat(head, length)
    powers = np.cumprod(np.full(int(length.max()), _STEP, np.uint64), dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTE[b[at]] * powers[place], head) + length.astype(np.uint64)), at[head]


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of all runs of ``words`` words, sorted; the whole text as one run where it has fewer."""
    h = word_hashes(text)
    n = min(words, len(h))
    if not n:
        return h
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total = (total + h[j : len(h) - n + 1 + j]) * _STEP
    return np.unique(mixed(total + np.uint64(n)))


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """The least of each of ``coordinates`` 32-bit hashes over a set that isn't empty."""
    low = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        low = np.minimum(low, (found[i : i + 1024, None] * _FACTORS[:coordinates] + _ADDED[:coordinates]).min(axis=0))
    return (low >> np.uint64(32)).astype(np.int64)


def _key(found: np.ndarray) -> bytes | None:
    """A digest of a set, None if it is empty."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def bitmap(found: np.ndarray) -> bytes:
    """Of each of ``BITS`` hash classes whether an odd number of a set's members falls into it."""
    return np.packbits(np.bincount((found >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _signatures(words: int, coordinates: int):
    def run(frames):
        for pdf in frames:
            rows = []
            for i, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                s = shingles(text, words)
                if len(s):
                    rows.append((i, len(s), _key(s), signature(s, coordinates).astype("<u4").tobytes(), bitmap(s)))
                else:
                    rows.append((i, 0, None, None, None))
            got = pd.DataFrame(rows, columns=["doc_id", "n", "key", "sig", "bits"])
            yield got.astype({"doc_id": "Int64"})

    return run


def unpacked(signatures: pd.Series) -> np.ndarray:
    """The 32-bit values of signatures, a row for each."""
    return np.frombuffer(b"".join(signatures), "<u4").reshape(len(signatures), -1)


def bitmaps(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1)


def values(signatures: pd.Series) -> np.ndarray:
    """One 64-bit number for each coordinate and its value; a row for each signature."""
    sig = unpacked(signatures).astype(np.uint64)
    return mixed(sig | np.arange(1, sig.shape[1] + 1, dtype=np.uint64) << np.uint64(32))


def cells(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _counted(frames):
    total = np.zeros(CELLS, np.int64)
    for pdf in frames:
        if len(pdf):
            total += np.bincount(cells(values(pdf["sig"])).ravel(), minlength=CELLS)
    yield pd.DataFrame({"slice": range(SLICES), "counts": [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(total, SLICES)]})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in pdf["counts"])
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [zlib.compress(np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes(), 1)]})


def rarity(nodes: DataFrame) -> np.ndarray:
    """How often values fall into each cell."""
    rows = nodes.select("sig").mapInPandas(_counted, "slice int, counts binary").groupBy("slice").applyInPandas(_added, "slice int, counts binary").collect()
    out = np.zeros((SLICES, CELLS // SLICES), np.uint32)
    for r in rows:
        out[r[0]] = np.frombuffer(zlib.decompress(r[1]), "<u4")
    return out.ravel()


def _prefixes(shared, pdf: pd.DataFrame, prefix: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of each node, the numbers of its ``prefix`` rarest ones, and its band of set sizes: similar sets are of one band or of adjacent ones."""
    value = values(pdf["sig"])
    order = shared.value[cells(value)].astype(np.uint64) << np.uint64(32) | value & np.uint64(0xFFFFFFFF)
    band = np.floor(np.log(pdf["n"].to_numpy()) / (max(np.log(100 / percent), 1e-3) + 1e-9)).astype(np.int64)
    return value, np.argsort(order, axis=1, kind="stable")[:, :prefix], band


def _posted(shared, prefix: int, percent: int):
    """Of each node the keys of its rarest values in its band of set sizes and in the next one: sets of sufficient similarity share one."""

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            value, rarest, band = _prefixes(shared, pdf, prefix, percent)
            first = np.take_along_axis(value, rarest, axis=1)
            keys = np.concatenate([mixed(first ^ mixed((band.astype(np.uint64)[:, None] + np.uint64(k)) * _STEP)) for k in (0, 1)], axis=1)
            yield pd.DataFrame({"post": keys.astype(np.int64).ravel(), "node": np.repeat(pdf["node"].to_numpy(), keys.shape[1])})

    return run


def _sketched(shared, prefix: int, percent: int):
    """Nodes with their bands and, as a mask, which of their coordinates are posted."""

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            value, rarest, band = _prefixes(shared, pdf, prefix, percent)
            posted = np.zeros(value.shape, np.uint8)
            np.put_along_axis(posted, rarest, 1, axis=1)
            yield pdf[["node", "n", "sig", "bits"]].assign(band=band, posted=[x.tobytes() for x in np.packbits(posted, axis=1)])

    return run


def possible(n_a: np.ndarray, n_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps may be similar enough."""
    total = n_a + n_b
    most = (total - np.bitwise_count(bits_a ^ bits_b).sum(axis=1, dtype=np.int64)) // 2
    most = np.minimum(most, np.minimum(n_a, n_b))
    return 100 * most >= percent * (total - most)


def _merged(percent: int, least: int):
    """The pairs (a, b) of different parts that postings lead to, from rows sorted by list, block and role: queries, both, documents."""

    def pairs(pdf: pd.DataFrame):
        post, role = pdf["post"].to_numpy(), pdf["role"].to_numpy()
        xb, yb = pdf["xb"].to_numpy(), pdf["yb"].to_numpy()
        node, part, n, band, most = (pdf[c].to_numpy() for c in ("node", "part", "n", "band", "most"))
        sig, bits = unpacked(pdf["sig"]), bitmaps(pdf["bits"])
        posted = np.unpackbits(np.frombuffer(b"".join(pdf["posted"]), np.uint8).reshape(len(pdf), -1), axis=1)[:, : sig.shape[1]].astype(bool)
        own = np.r_[True, (post[1:] != post[:-1]) | (xb[1:] != xb[:-1]) | (yb[1:] != yb[:-1])]
        stop = np.r_[np.flatnonzero(own)[1:], len(pdf)][np.cumsum(own) - 1]
        first = np.r_[np.flatnonzero(own), len(pdf)][np.cumsum(own) - 1]
        asked = np.r_[0, np.cumsum(role == QUERY)]
        start = first + asked[stop] - asked[first]
        x = np.flatnonzero(role != DOCUMENT)
        size = (stop - start)[x]
        for some in np.split(x, np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1):
            i, j = np.repeat(some, (stop - start)[some]), ragged(start[some], (stop - start)[some])
            good = (part[i] != part[j]) & ((part[j] == most[j]) | (node[i] < node[j])) & (np.abs(band[i] - band[j]) <= 1)
            good[good] = possible(n[i[good]], n[j[good]], bits[i[good]], bits[j[good]], percent)
            i, j = i[good], j[good]
            same = sig[i] == sig[j]
            good = same.sum(axis=1) >= least
            i, j, same = i[good], j[good], same[good]
            common = same & posted[i] & posted[j]
            # the list of the first common posting, in the larger of the two bands
            here = common.argmax(axis=1)
            good = common.any(axis=1) & (post[i] == mixed(_values_at(sig, i, here) ^ mixed(np.maximum(band[i], band[j]).astype(np.uint64) * _STEP)).astype(np.int64))
            yield pd.DataFrame({"a": np.minimum(node[i], node[j])[good], "b": np.maximum(node[i], node[j])[good]})

    def run(frames):
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf[["post", "xb", "yb"]].to_numpy()
            same = (last == last[-1:]).all(axis=1) if len(pdf) else np.zeros(0, bool)
            whole = int(np.argmax(same)) if len(pdf) else 0
            held = pdf.iloc[whole:].reset_index(drop=True)
            if whole:
                yield from pairs(pdf.iloc[:whole])
        if held is not None and len(held):
            yield from pairs(held)

    return run


def _values_at(sig: np.ndarray, rows: np.ndarray, coordinate: np.ndarray) -> np.ndarray:
    """The number, as in ``values``, of one coordinate of each row."""
    return mixed(sig[rows, coordinate].astype(np.uint64) | (coordinate.astype(np.uint64) + np.uint64(1)) << np.uint64(32))


def _sets(words: int):
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"node": pdf["doc_id"], "own": [shingles(t, words).tobytes() for t in pdf["text"]]})

    return run


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    own = id_text(docs, id_col, text_col)
    signed = written(own.mapInPandas(_signatures(words, coordinates), "doc_id long, n long, key binary, sig binary, bits binary"), "minhash")
    some = signed.filter("key is not null and doc_id is not null")
    nodes = written(some.groupBy("key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n", "sig", "bits"))), "minhash-nodes")
    order = docs.sparkSession.sparkContext.broadcast(rarity(nodes))
    prefix = coordinates - least + 1
    posts = nodes.mapInPandas(_posted(order, prefix, percent), "post long, node long")
    lists = written(posts.groupBy("post").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"), "minhash-lists")
    posts = written(posts.join(lists, "post"), "minhash-posts")
    common = F.pandas_udf(_common, "long")

    @F.pandas_udf("boolean")
    def alike(n_a: pd.Series, low_a: pd.Series, bits_a: pd.Series, n_b: pd.Series, low_b: pd.Series, bits_b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (low_a, low_b))
        return pd.Series(((x == y).sum(axis=1) >= least) & possible(n_a.to_numpy(), n_b.to_numpy(), bitmaps(bits_a), bitmaps(bits_b), percent))

    @F.pandas_udf("binary")
    def lowest(signatures: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in (unpacked(signatures) & 255).astype(np.uint8)])

    low = nodes.select("node", "n", lowest("sig").alias("low"), "bits")

    def confirmed(near: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        needed = written(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "minhash-needed")
        full = own.join(needed, "doc_id").mapInPandas(_sets(words), "node long, own binary")
        x, y = (full.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
        both = near.join(x, "a").join(y, "b").select("a", "b", common("own_a", "own_b").alias("both"), F.expr("length(own_a) div 8 + length(own_b) div 8").alias("sum"))
        return written(both.filter(F.col("both") * 100 >= percent * (F.col("sum") - F.col("both"))).select("a", "b").distinct(), "minhash-links")

    star = posts.select("node", F.explode(F.array("lo", "hi")).alias("other")).filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    x, y = (low.toDF(c, f"n_{c}", f"low_{c}", f"bits_{c}") for c in "ab")
    star = star.join(x, "a").join(y, "b").filter(alike("n_a", "low_a", "bits_a", "n_b", "low_b", "bits_b")).select("a", "b").distinct()
    links = confirmed(written(star, "minhash-pairs"))
    # rows of one id whose sets belong to different nodes tie these nodes together
    several = written(some.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("other")).filter("key < other").select("doc_id"), "minhash-repeated")
    owners = some.join(several, "doc_id").join(nodes.select("key", "node"), "key").select("doc_id", "node").distinct()
    links = links.union(owners.join(owners.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("node").alias("b")).filter("a <> b"))
    parts = written(components(links), "minhash-parts")

    inner = posts.filter("node <> lo and node <> hi")  # a list's smallest and largest node have been compared with all of it
    placed = written(inner.select("post", "node").join(parts, "node", "left").select("post", "node", F.coalesce("component", "node").alias("part")), "minhash-placed")
    sizes = placed.groupBy("post", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("post").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    split = written(sizes.select("post", F.col("most.part").alias("most"), blocks(F.col("n") - F.col("most.n"), QUERY_BLOCK).alias("nx"), blocks(F.col("n"), BLOCK).alias("ny")), "minhash-split")
    placed = written(placed.join(split, "post"), "minhash-mixed")
    every, of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    role = F.when(F.col("part") == F.col("most"), F.lit(DOCUMENT)).otherwise(F.lit(BOTH))
    rows = placed.filter("nx = 1 and ny = 1").select("post", F.lit(0).alias("xb"), F.lit(0).alias("yb"), role.alias("role"), "node", "part", "most")
    large = placed.filter("nx > 1 or ny > 1")
    rows = rows.union(large.filter("part <> most").select("post", of("nx").alias("xb"), every("ny").alias("yb"), F.lit(QUERY).alias("role"), "node", "part", "most"))
    rows = rows.union(large.select("post", every("nx").alias("xb"), of("ny").alias("yb"), F.lit(DOCUMENT).alias("role"), "node", "part", "most"))
    sketches = nodes.join(placed.select("node").distinct(), "node", "left_semi").mapInPandas(_sketched(order, prefix, percent), "node long, n long, sig binary, bits binary, band long, posted binary")
    rows = rows.join(sketches, "node").repartition("post", "xb", "yb").sortWithinPartitions("post", "xb", "yb", "role")
    rest = written(rows.mapInPandas(_merged(percent, least), "a long, b long").distinct(), "minhash-rest")
    parts = written(components(links.union(confirmed(rest))), "minhash-parts")

    got = signed.select("doc_id", "n", "key").join(nodes.select("key", "node"), "key", "left")
    got = got.join(parts, "node", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` marks as kept: without those linked, over any number of links, with a smaller doc_id. Columns may have any names."""
    marked = near_duplicates(docs, words, percent, id_col, text_col, coordinates, least)
    id_name, text_name, lost_name = column(id_col), column(text_col), unused(docs, "lost")
    lost = written(marked.filter(~F.col("kept")).select(F.col("doc_id").alias(lost_name)).distinct(), "minhash-lost")
    return docs.join(lost, (F.col(lost_name) == id_name) & text_name.cast("string").rlike(r"[^\x20\x09-\x0D]"), "left_anti")
