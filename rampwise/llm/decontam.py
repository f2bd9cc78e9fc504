"""Benchmark decontamination by suffix arrays over shards of the training documents.

Each executor task builds, shard by shard (about ``SHARD_BYTES`` of text), a suffix array over the word sequence of its
documents by prefix doubling, and binary-searches every suffix of every benchmark item in it, narrowing the interval of
equal suffixes word by word. Suffixes that reach a whole window (``window`` words; all words of a shorter item) give intervals of the suffix
array, which are equal or apart for windows of one length: the words that they cover, the longest spans of such words in each
document, and the items that meet there come from the intervals themselves, and no pairs of positions are made. Only where ``matches`` are asked for, all pairs of
equal positions are listed and those that continue each other on the same diagonal joined to longest matches of one item with one
document; in texts that repeat a word over and over these are as many as the product of the lengths.

Only runs of words that all occur in the benchmark, as long as its shortest window, enter the suffix array: no window can
lie elsewhere. The benchmark is searched in blocks of bounded size (``block_bytes``), one after another: each is sent to all executors, its findings are written under
the digests of the texts that it hits, and it is taken back before the next, so that no worker holds more than one. A benchmark of one block needs no table in between.

Null, empty and wordless texts have no words and no matches; items without words never match; items whose id is null
match words but aren't listed; repeated rows are treated each for itself; items that repeat an id count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import column, columns, ragged, unused, written

WINDOW = 10
#: Documents of about so many bytes of text share a suffix array.
SHARD_BYTES = 16 << 20
#: Benchmark text that is sent to the executors at once.
BLOCK_BYTES = 16 << 20
#: What is found in a document: the spans of covered words, the items met, and longest matches.
ARRAYS = {"start": "long", "span": "long", "met": "string", "item": "string", "item_pos": "long", "doc_pos": "long", "length": "long"}

#: Lower-cases A-Z and turns every byte that isn't in a word (0-9, a-z, 0x80 and above) to a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Items:
    """A block of benchmark items as one sequence of word ids, and the suffixes to search."""

    def __init__(self, rows: list[tuple], window: int):
        vocabulary: dict[bytes, int] = {}
        sequences = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(bytes(t or b""))], np.int64) for _, t in rows]
        self.ids = [None if i is None else str(i) for i, _ in rows]
        self.vocabulary = vocabulary
        self.words = np.concatenate([*sequences, np.zeros(0, np.int64)])
        starts = np.cumsum([0, *(len(s) for s in sequences)])
        self.suffix, self.item, self.need = [], [], []
        for k, s in enumerate(sequences):
            n = min(window, len(s))
            count = len(s) - n + 1 if n else 0
            self.suffix.append(starts[k] + np.arange(count))
            self.item.append(np.full(count, k))
            self.need.append(np.full(count, n))
        self.suffix, self.item, self.need = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (self.suffix, self.item, self.need))
        self.place = self.suffix - starts[self.item] if len(self.item) else self.suffix
        self.shortest = int(self.need.min()) if len(self.need) else 0
        self.longest = int(self.need.max()) if len(self.need) else 0


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``seq`` (values >= -1), sorted by their first ``depth`` values at least, by prefix doubling."""
    rank, k = seq + 1, 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        dense = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank = np.empty_like(dense)
        rank[order] = dense
        if k >= depth or dense[-1] == len(seq) - 1:
            return order
        rank = (rank + 1) * (len(seq) + 2) + np.r_[rank[k:] + 1, np.zeros(min(k, len(seq)), np.int64)]
        order = np.argsort(rank, kind="stable")
        k *= 2


def search(seq: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix that occurs with all its needed words: its number, and the interval of the suffix array that holds it."""
    padded = np.r_[seq, np.full(items.longest + 1, -2)]
    q = np.arange(len(items.suffix))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    done: list[tuple] = []
    for depth in range(items.longest + 1):
        full = items.need[q] == depth
        if full.any():
            done.append((q[full], lo[full], hi[full]))
            q, lo, hi = q[~full], lo[~full], hi[~full]
        if not len(q):
            break
        target = items.words[items.suffix[q] + depth]
        bounds = []
        for after in (False, True):
            left, right = lo.copy(), hi.copy()
            while (open_ := left < right).any():
                mid = (left + right) >> 1
                at = padded[order[np.where(open_, mid, 0)] + depth]
                go = open_ & ((at <= target) if after else (at < target))
                left, right = np.where(go, mid + 1, left), np.where(open_ & ~go, mid, right)
            bounds.append(left)
        lo, hi = bounds
        some = lo < hi
        q, lo, hi = q[some], lo[some], hi[some]
    if not done:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def covered(order: np.ndarray, size: int, need: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in an occurrence of a window, from the intervals of the suffix array that hold the occurrences' starts."""
    change = np.zeros(size + 1, np.int64)
    for n in np.unique(need):
        own = need == n
        starts = np.zeros(len(order) + 1, np.int64)
        np.add.at(starts, lo[own], 1)
        np.add.at(starts, hi[own], -1)
        at = order[np.cumsum(starts[:-1]) > 0]
        np.add.at(change, at, 1)
        np.add.at(change, np.minimum(at + n, size), -1)
    return np.cumsum(change[:-1]) > 0


def met(order: np.ndarray, doc: np.ndarray, item: np.ndarray, need: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_items: int, most: int = 1 << 20) -> np.ndarray:
    """The distinct numbers doc * n_items + item of documents (``doc``: of each position) and items that share a window."""
    found = np.zeros(0, np.int64)
    for n in np.unique(need):
        own = np.flatnonzero(need == n)
        heads, first, which = np.unique(lo[own], return_index=True, return_inverse=True)
        length = hi[own][first] - heads
        slot = ragged(heads, length)
        place = np.unique(np.repeat(np.arange(len(heads)), length) * (doc.max() + 1) + doc[order[slot]])
        interval, docs = np.divmod(place, doc.max() + 1)
        side = np.unique(which * n_items + item[own])
        begin = np.searchsorted(side, np.arange(len(heads) + 1) * n_items)
        count = np.diff(begin)[interval]
        for some in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(np.cumsum(count) // most)) + 1):
            pairs = np.repeat(docs[some] * n_items, count[some]) + side[ragged(begin[interval[some]], count[some])] % n_items
            found = np.union1d(found, pairs)
    return found


def _shard(texts: list[bytes], items: Items, matches: bool) -> list[dict]:
    get, sequences = items.vocabulary.get, []
    for text in texts:
        words = words_of(text)
        sequences.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
    out = [{"n_words": len(s)} | {c: [] for c in ARRAYS} for s in sequences]
    if not items.shortest:
        return out
    starts = np.cumsum([0, *(len(s) + 1 for s in sequences)])
    seq = np.full(starts[-1], -1, np.int64)
    for s, at in zip(sequences, starts, strict=False):
        seq[at : at + len(s)] = s
    inside = np.r_[False, seq >= 0]  # the last value of seq is always a separator
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if len(edges) % 2:
        edges = np.r_[edges, len(seq)]
    first, last = edges[0::2], edges[1::2]
    long = last - first >= items.shortest
    first, last = first[long], last[long]
    if not len(first):
        return out
    size = last - first + 1  # with the separator that follows
    where = ragged(first, size)
    kept = seq[where]
    order = suffix_array(kept, items.longest)
    q, lo, hi = search(kept, order, items)
    if not len(q):
        return out
    doc = np.searchsorted(starts, where, side="right") - 1
    hit = np.r_[False, covered(order, len(kept), items.need[q], lo, hi), False]
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        d = out[doc[a]]
        d["start"].append(int(where[a] - starts[doc[a]]))
        d["span"].append(b - a)
    for k in met(order, doc, items.item[q], items.need[q], lo, hi, len(items.ids)).tolist():
        out[k // len(items.ids)]["met"].append(items.ids[k % len(items.ids)])
    if matches:
        _longest(out, order, where, starts, items, q, lo, hi)
    return out


def _longest(out: list[dict], order: np.ndarray, where: np.ndarray, starts: np.ndarray, items: Items, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Adds the longest matches of each item with each document, from all pairs of equal positions."""
    position, suffix = where[order[ragged(lo, hi - lo)]], np.repeat(q, hi - lo)
    doc = np.searchsorted(starts, position, side="right") - 1
    item, item_pos, doc_pos, need = items.item[suffix], items.place[suffix], position - starts[doc], items.need[suffix]
    by = np.lexsort((doc_pos, doc_pos - item_pos, item, doc))
    doc, item, item_pos, doc_pos, need = doc[by], item[by], item_pos[by], doc_pos[by], need[by]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (doc_pos[1:] != doc_pos[:-1] + 1) | (item_pos[1:] != item_pos[:-1] + 1)]
    head = np.flatnonzero(new)
    length = np.diff(np.r_[head, len(doc)]) - 1 + need[head]
    for k, n in zip(head.tolist(), length.tolist(), strict=True):
        d = out[doc[k]]
        d["item"].append(items.ids[item[k]])
        d["item_pos"].append(int(item_pos[k]))
        d["doc_pos"].append(int(doc_pos[k]))
        d["length"].append(n)


def _searcher(shared, matches: bool, shard_bytes: int):
    @F.pandas_udf("n_words long, " + ", ".join(f"{c} array<{kind}>" for c, kind in ARRAYS.items()))
    def search_shards(texts: pd.Series) -> pd.DataFrame:
        items, out, held, n = shared.value, [], [], 0
        for text in texts:
            held.append(text or b"")
            n += len(held[-1])
            if n >= shard_bytes:
                out += _shard(held, items, matches)
                held, n = [], 0
        out += _shard(held, items, matches) if held else []
        return pd.DataFrame(out, columns=["n_words", *ARRAYS])

    return search_shards


def _covered(start: pd.Series, length: pd.Series) -> pd.Series:
    """How many positions the spans of each row cover."""
    out = []
    for s, n in zip(start, length, strict=True):
        if s is None or not len(s):
            out.append(0)
            continue
        s, n = np.asarray(s), np.asarray(n)
        by = np.argsort(s, kind="stable")
        s, e = s[by], (s + n)[by]
        before = np.r_[0, np.maximum.accumulate(e)[:-1]]
        out.append(int(np.maximum(0, e - np.maximum(s, before)).sum()))
    return pd.Series(out)


def blocks_of(items: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[Items]]:
    """The number of blocks of about ``block_bytes`` of benchmark text, and the blocks, one after another: the driver holds one at a time."""
    own = items.select(column(id_col).alias("i"), column(text_col).cast("binary").alias("t"))
    total = own.agg(F.sum(F.length("t"))).head()[0] or 0
    n = 1 + total // block_bytes
    part = lambda k: own if n == 1 else own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
    return n, (Items(sorted(((r[0], r[1]) for r in part(k).toLocalIterator()), key=str), window) for k in range(n))


def _n_words(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(t or b"")) for t in texts], dtype="int64")


def _by_blocks(docs: DataFrame, blocks: Iterator[Items], text: Column, matches: bool, shard_bytes: int) -> DataFrame:
    """(key, arrays) of all texts with a hit, ``key`` their SHA-256: what is found depends on the text alone.

    Each block is sent, searched, its findings are written, and it is taken back from the executors before the next.
    """
    spark, found = docs.sparkSession, None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        own = docs.select(text.alias("text")).select(F.sha2("text", 256).alias("key"), _searcher(shared, matches, shard_bytes)(F.col("text")).alias("f"))
        here = written(own.filter(F.size("f.start") > 0).select("key", *(F.col(f"f.{c}").alias(c) for c in ARRAYS)).dropDuplicates(["key"]), "decontam-block")
        shared.destroy()
        found = here if found is None else found.union(here)
    return written(found.groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ARRAYS)), "decontam-found")


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, to: str = "found", matches: bool = True) -> DataFrame:
    """``docs`` with a struct ``to``, which replaces a column of that name: n_words, n_hit, item_ids (distinct, sorted), spans (start and length in words of the
    longest runs of words that one block of the benchmark covers), matches (item_id, item_pos, doc_pos, length in words; empty unless ``matches``)."""
    text: Column = column(text_col).cast("binary")
    n, blocks = blocks_of(items, window, item_id_col, item_text_col, block_bytes)
    part = unused(docs, f"_{to}")
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(blocks))
        got = docs.select("*", _searcher(shared, matches, shard_bytes)(text).alias(part))
    else:
        found, key = _by_blocks(docs, blocks, text, matches, shard_bytes), unused(docs, f"_{to}_key")
        none = {c: F.array().cast(f"array<{kind}>") for c, kind in ARRAYS.items()}
        found = found.select(F.col("key").alias(key), F.struct(*ARRAYS).alias(part))
        own = docs.select("*", F.sha2(text, 256).alias(f"{key}_own"), F.pandas_udf(_n_words, "long")(text).alias(f"{part}_n")).join(found, F.col(f"{key}_own") == F.col(key), "left")
        got = own.withColumn(part, F.struct(F.col(f"{part}_n").alias("n_words"), *(F.coalesce(F.col(part)[c], none[c]).alias(c) for c in ARRAYS)))
    joined = {c: F.col(part)[c] for c in ARRAYS}
    return got.select(*(column(c) for c in docs.columns if c.lower() != to.lower()), F.struct(
        F.col(part)["n_words"].alias("n_words"),
        F.pandas_udf(_covered, "long")(joined["start"], joined["span"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.filter(joined["met"], lambda x: x.isNotNull()))).alias("item_ids"),
        F.arrays_zip(joined["start"].alias("start"), joined["span"].alias("length")).alias("spans"),
        F.arrays_zip(*(joined[c].alias(c) for c in ("item", "item_pos", "doc_pos", "length"))).alias("matches"),
    ).alias(to))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs."""
    to = unused(docs, "decontam")
    got = find(docs, items, to=to, **({"matches": False} | options))
    return got.filter(F.col(to)["n_hit"] == 0).select(*columns(docs))
