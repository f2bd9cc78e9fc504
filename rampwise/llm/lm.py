"""Language-model scoring by context-tree weighting over bytes (Willems, Shtarkov and Tjalkens, 1995).

A byte is eight binary decisions; each decision has a tree of contexts of 0 to ``DEPTH`` preceding bytes. A node holds the
counts of zeros and ones seen there and their Krichevsky-Trofimov block probability Pe; its weighted probability is
Pw = (Pe + product of the children's Pw) / 2, and Pw = Pe at the full depth. The prediction of a bit mixes the estimates of
all depths along its context, each node's with weight Pe / (2 Pw) and the rest left to the child; a context that was never
seen takes its parent's estimate. The code length of a text is the sum over its bytes and an end mark (the byte FF, which
UTF-8 never has; it also stands before the text).

1. Chunks of documents (about ``CHUNK_BYTES`` of text) give their distinct runs of DEPTH + 1 bytes and their distinct words,
   each with its count in training documents, as packed blocks dealt out by a hash of the two bytes before the last, or of
   the word.
2. Blocks are merged in two steps: first those of ``GROUP`` chunks, then all of a part. The number of parts is that of
   shuffle partitions. All distinct runs are kept, so what is gathered grows with the corpus.
3. A part computes its subtrees; the two upper levels (at most 65,281 nodes, a proven bound) are added up by Spark and sent
   to all executors.
4. Each part scores its distinct runs once. The values go back the way the runs came: to the groups of chunks, each only those
   of its own runs, and from these to the chunks, where documents are added up. No model is copied.

Null texts are empty: one token, the end. Null ids count as held out. Rows that repeat are scored each for itself. Without
training documents every bit has probability 1/2 and no token is known.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import column, held_out, small_batches, written

DEPTH = 5
CHUNK_BYTES = 4 << 20
#: Chunks whose blocks are merged, or scored, in one group.
GROUP = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PAD = b"\xff" * DEPTH
_SMALL = 4096
_HALF = np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])
_ONE = np.array([math.lgamma(n + 1.0) for n in range(_SMALL)])


def log_gamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """The logarithm of gamma(n + shift): small n by a table, others by Stirling's series."""
    x = np.maximum(n, 64) + shift
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1)], far)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a, _HALF, 0.5) + log_gamma(b, _HALF, 0.5) - log_gamma(a + b, _ONE, 1.0) - math.log(math.pi)


def packed(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64)


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end mark of the texts: the byte with the DEPTH bytes before it (the nearest in the highest place); and how many each text has. In place, as the arrays are eight times the text."""
    joined = b"".join(x for t in texts for x in (_PAD, t, b"\xff"))
    b = np.frombuffer(joined, np.uint8)
    length = np.array([len(t) + 1 for t in texts], np.int64)
    key = np.zeros(len(b), np.uint64)
    for k in range(1, DEPTH + 1):
        before = b[:-k].astype(np.uint64)
        before <<= np.uint64(8 * (DEPTH + 1 - k))
        key[k:] |= before
        del before
    key |= b
    symbol = np.ones(len(b), bool)
    starts = np.cumsum(length + DEPTH) - length - DEPTH
    for k in range(DEPTH):
        symbol[starts + k] = False
    return key[symbol], length


def run_parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each run, by the two bytes before its last."""
    two = (keys >> np.uint64(8 * (DEPTH - 1))) & np.uint64(0xFFFF)
    return (((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)


def by_part(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by part, and (part, start, stop) of each in it."""
    order = np.argsort(part, kind="stable")
    own = part[order]
    edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(0, int)
    return order, [(int(own[i]), int(i), int(j)) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def word_parts(words, parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))


def _chunks(frames, chunk_bytes: int):
    """Lists of (doc_id, text, held_out) with about ``chunk_bytes`` of text, 65,536 rows at most."""
    held, n = [], 0
    for pdf in frames:
        for row in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["held_out"].tolist(), strict=True):
            held.append((None if pd.isna(row[0]) else int(row[0]), row[1].translate(_LOWER), bool(row[2])))
            n += len(row[1])
            if n >= chunk_bytes or len(held) == 1 << 16:
                yield held
                held, n = [], 0
    if held:
        yield held


def _gathered(parts: int, chunk_bytes: int):
    def run(frames):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24
        for number, rows in enumerate(_chunks(frames, chunk_bytes)):
            chunk = first + number
            key, length = runs([t for _, t, _ in rows])
            key <<= np.uint64(1)
            key |= np.repeat(np.array([not out for _, _, out in rows]), length)
            key.sort()
            learned = key.astype(np.uint8) & np.uint8(1)
            key >>= np.uint64(1)
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, counts = key[head], np.add.reduceat(learned, head, dtype=np.int64)
            del learned, head
            counted, tokens = Counter(), 0
            words: dict[bytes, None] = {}
            for _, text, out in rows:
                own = text.split()
                words.update(dict.fromkeys(own))
                if not out:
                    counted.update(own)
                    tokens += len(own) + 1
            body = zstandard.compress(b"".join(t for _, t, _ in rows), 3)
            frame = [(chunk, -1, "text", [i for i, _, _ in rows], [out for *_, out in rows], [len(t) for _, t, _ in rows], tokens, body, None)]
            order, some = by_part(run_parts(key, parts))
            frame += [(chunk, p, "runs", None, None, None, None, pack_sorted(key[order[i:j]]), packed(counts[order[i:j]])) for p, i, j in some]
            listed = list(words)
            order, some = by_part(word_parts(listed, parts))
            for p, i, j in some:
                own = [listed[k] for k in order[i:j]]
                frame.append((chunk, p, "words", None, None, None, None, zstandard.compress(b"\n".join(own), 1), packed(np.array([counted.get(w, 0) for w in own], np.int64))))
            for at in range(0, len(frame), 64):
                yield pd.DataFrame(frame[at : at + 64], columns=["chunk", "part", "kind", "ids", "out", "sizes", "tokens", "body", "counts"]).astype({"tokens": "Int64"})

    return run


def merge_runs(blocks) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of (keys, counts) blocks, sorted, with the sums of their counts."""
    key, count = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order].astype(np.int64)
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[head], np.add.reduceat(count, head)


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """All blocks of a group of one kind and part as one block."""
    if pdf["kind"].iloc[0] == "runs":
        key, count = merge_runs([(unpack_sorted(b), unpacked(c)) for b, c in zip(pdf["body"], pdf["counts"], strict=True)])
        body = pack_sorted(key)
    else:
        total: dict[bytes, int] = {}
        for b, c in zip(pdf["body"], pdf["counts"], strict=True):
            for w, n in zip(zstandard.decompress(b).split(b"\n"), unpacked(c).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        body, count = zstandard.compress(b"\n".join(total), 1), np.fromiter(total.values(), np.int64, len(total))
    own = {c: pdf[c].iloc[:1].tolist() for c in ("part", "kind", "salt") if c in pdf}
    return pd.DataFrame({**own, "body": [body], "counts": [packed(count)], "known": [int((count > 0).sum())]})


class Tree:
    """The levels ``DEPTH`` to 2 over distinct runs (sorted) with their training counts, zero for runs of held-out documents only."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        eight = np.uint64(8)
        self.keys, self.up, self.node, self.seen, self.one, self.stay = keys, {}, {}, {}, {}, {}
        weighted: dict[int, np.ndarray] = {}
        below = None
        for depth in range(DEPTH, 1, -1):
            if depth < DEPTH:
                keys, self.up[depth] = np.unique(((below >> np.uint64(16)) << eight) | (below & np.uint64(255)), return_inverse=True)
                counts = np.bincount(self.up[depth], counts, len(keys)).astype(np.int64)
            for t in range(8):
                at = keys >> np.uint64(8 - t)
                new = np.r_[True, at[1:] != at[:-1]]
                node, head = np.cumsum(new) - 1, np.flatnonzero(new)
                bit = ((keys >> np.uint64(7 - t)) & np.uint64(1)).astype(bool)
                b = np.add.reduceat(np.where(bit, counts, 0), head)
                a = np.add.reduceat(counts, head) - b
                kt = log_kt(a, b)
                if depth == DEPTH:
                    own = kt
                    stay = np.ones(len(kt))
                else:
                    child = self.node[depth + 1, t]
                    first = np.flatnonzero(np.r_[True, child[1:] != child[:-1]])
                    rest = np.bincount(node[self.up[depth][first]], weighted[t], len(head))
                    own = np.logaddexp(kt, rest) - math.log(2)
                    stay = np.exp(kt - own - math.log(2))
                weighted[t] = own
                self.node[depth, t], self.seen[depth, t], self.one[depth, t], self.stay[depth, t] = node, a + b > 0, (b + 0.5) / (a + b + 1), stay
            below = keys
        self.top_keys, self.top_counts, self.weighted = keys, counts, weighted

    def upper(self) -> pd.DataFrame:
        """For the nodes of depth 1: counts, and the sum of the logarithms of their children's weighted probabilities."""
        out = []
        for t in range(8):
            node = self.node[2, t]
            head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            bit = (self.top_keys >> np.uint64(7 - t)) & np.uint64(1)
            b = np.add.reduceat(np.where(bit == 1, self.top_counts, 0), head)
            a = np.add.reduceat(self.top_counts, head) - b
            first = self.top_keys[head]
            at = ((first >> np.uint64(16)) & np.uint64(255)) << np.uint64(8) | np.uint64(1 << t) | ((first & np.uint64(255)) >> np.uint64(8 - t))
            out.append(pd.DataFrame({"node": at.astype(np.int64), "a": a, "b": b, "rest": self.weighted[t]}))
        return pd.concat(out).groupby("node", as_index=False).sum()

    def log10(self, top: tuple) -> np.ndarray:
        """The logarithm of the probability of each run's last byte after the bytes before it."""
        total = np.zeros(len(self.keys))
        y = (self.keys & np.uint64(255)).astype(np.int64)
        first = (self.keys >> np.uint64(8 * DEPTH)).astype(np.int64)
        for t in range(8):
            bit = ((y >> (7 - t)) & 1).astype(bool)
            at = np.arange(len(y))
            q, seen = None, None
            for depth in range(DEPTH, 1, -1):
                at = at if depth == DEPTH else self.up[depth][at]
                node = self.node[depth, t][at]
                one, stay = self.one[depth, t][node], self.stay[depth, t][node]
                p = np.where(bit, one, 1 - one)
                q = p if q is None else np.where(seen, stay * p + (1 - stay) * q, p)
                seen = self.seen[depth, t][node]
            node = (1 << t) | (y >> (8 - t))
            for one, stay, known in top:
                place = (first << 8 | node) if len(one) > 256 else node
                p = np.where(bit, one[place], 1 - one[place])
                q = np.where(seen, stay[place] * p + (1 - stay[place]) * q, p)
                seen = known[place]
            total += np.log10(q)
        return total


def upper_levels(rows: list[tuple]) -> tuple:
    """(probability of a one, weight, seen) of the nodes of depth 1 and 0, from (node, a, b, rest) of those of depth 1."""
    node = np.array([r[0] for r in rows], np.int64)
    out, a, b = [], *(np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    rest = np.array([r[3] for r in rows], float)
    for size in (1 << 16, 256):
        at = node % size
        count = [np.bincount(at, x, size).astype(np.int64) for x in (a, b)]
        kt = log_kt(*count)
        own = np.logaddexp(kt, np.bincount(at, rest, size)) - math.log(2)
        out.append(((count[1] + 0.5) / (count[0] + count[1] + 1), np.exp(kt - own - math.log(2)), count[0] + count[1] > 0))
        node, a, b, rest = np.arange(size), *count, own  # the next level adds up the nodes of this one
    return tuple(out)


def _uppers(frames):
    for pdf in frames:
        for body, counts in zip(pdf["body"], pdf["counts"], strict=True):
            yield Tree(unpack_sorted(body), unpacked(counts).astype(np.int64)).upper()


def _places(kind: str, body: bytes):
    """Of a merged block: a function from the body of a block whose keys it holds to their places in it."""
    if kind == "runs":
        keys = unpack_sorted(body)
        return lambda b: np.searchsorted(keys, unpack_sorted(b))
    at = {w: i for i, w in enumerate(zstandard.decompress(body).split(b"\n"))}
    return lambda b: np.fromiter(map(at.__getitem__, zstandard.decompress(b).split(b"\n")), np.int64)


def _valued(shared):
    """The values of a part's model for the keys of each group of chunks."""

    def run(model: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, body, counts in zip(model["kind"], model["body"], model["counts"], strict=True):
            place, value = _places(kind, body), unpacked(counts)
            if kind == "runs":
                value = Tree(unpack_sorted(body), value.astype(np.int64)).log10(shared.value).astype("<f4").view("<u4")
            out += [(part, kind, salt, b, packed(value[place(b)])) for part, salt, b in zip(groups["part"], groups["salt"], groups["body"], strict=True)]
        return pd.DataFrame(out, columns=["part", "kind", "salt", "body", "value"])

    return run


def _dealt(groups: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """The values of a group's keys for the keys of each of its chunks."""
    out = []
    for kind, body, value in zip(groups["kind"], groups["body"], groups["value"], strict=True):
        place, value = _places(kind, body), unpacked(value)
        out += [(chunk, part, kind, packed(value[place(b)])) for chunk, part, b in zip(blocks["chunk"], blocks["part"], blocks["body"], strict=True)]
    return pd.DataFrame(out, columns=["chunk", "part", "kind", "value"])


def _documents(parts: int, train_tokens: int, ends: int, distinct: int):
    """``ends``: the training documents, each with one end; ``distinct``: the distinct training tokens."""
    scale = math.log10(train_tokens + 0.1 * (distinct + 1))
    last = math.log10(ends + 0.1) - scale

    def run(chunks: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for ids, held, sizes, body in zip(chunks["ids"], chunks["out"], chunks["sizes"], chunks["body"], strict=True):
            whole = zstandard.decompress(body)
            texts = [whole[j - n : j] for j, n in zip(np.cumsum(sizes).tolist(), list(sizes), strict=True)]
            found = {(k, p): unpacked(v) for k, p, v in zip(values["kind"], values["part"], values["value"], strict=True)}
            key, length = runs(texts)
            key <<= np.uint64(16)
            key |= np.repeat(np.arange(len(texts), dtype=np.uint16), length)
            key.sort()
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            times = np.diff(np.r_[head, len(key)]).astype(np.int32)
            key = key[head]
            del head
            doc = key.astype(np.uint16)
            key >>= np.uint64(16)
            new = np.r_[True, key[1:] != key[:-1]]
            order, some = by_part(run_parts(key[new], parts))
            key = None
            value = np.empty(len(order), np.float32)
            value[order] = np.concatenate([found["runs", p].astype("<u4").view("<f4") for p, _, _ in some])
            score = np.bincount(doc, value[np.cumsum(new, dtype=np.int32) - 1] * times.astype(float), len(texts))
            del doc, times, new
            split = [t.split() for t in texts]
            words: dict[bytes, int] = {}
            for own in split:
                words.update(dict.fromkeys(own))
            listed = list(words)
            order, some = by_part(word_parts(listed, parts))
            count = np.empty(len(order), np.int64)
            count[order] = np.concatenate([np.zeros(0, np.int64), *(found["words", p].astype(np.int64) for p, _, _ in some)])
            words = dict(zip(listed, range(len(listed)), strict=True))
            logs = np.log10(count + 0.1) - scale
            for i, h, own, s, n in zip(ids, held, split, score.tolist(), list(sizes), strict=True):
                at = np.fromiter(map(words.__getitem__, own), np.int64, len(own))
                for k, v in zip(out, (None if pd.isna(i) else int(i), bool(h), len(own) + 1, int((count[at] > 0).sum()) + (ends > 0), float(logs[at].sum()) + last, s, int(n)), strict=True):
                    out[k].append(v)
        return pd.DataFrame(out).astype({"doc_id": "Int64"})

    return run


def score(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, group: int = GROUP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each whole text; the documents whose id leaves no remainder by ``folds`` are held out of learning."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("binary"), F.lit(b"")).alias("text"), held_out(column(id_col).cast("long"), folds).alias("held_out"))
    gathered = written(own.mapInPandas(_gathered(parts, chunk_bytes), "chunk long, part int, kind string, ids array<long>, out array<boolean>, sizes array<long>, tokens long, body binary, counts binary"), "lm-blocks")
    blocks = gathered.filter("kind <> 'text'").select("chunk", "part", "kind", "body", "counts")
    salts = 1 + gathered.filter("kind = 'text'").count() // group
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt")
    salted = blocks.select("*", salt)
    schema = "part int, kind string, {}body binary, counts binary, known long"
    groups = written(salted.groupBy("part", "kind", "salt").applyInPandas(_merged, schema.format("salt long, ")), "lm-groups")
    merged = written(groups.drop("salt").groupBy("part", "kind").applyInPandas(_merged, schema.format("")), "lm-merged")
    distinct = merged.filter("kind = 'words'").agg(F.sum("known")).head()[0] or 0
    learned = gathered.filter("kind = 'text'").agg(F.sum("tokens"), F.sum(F.size(F.filter("out", lambda x: ~x)))).head()
    train_tokens, n_train = learned[0] or 0, learned[1] or 0
    upper = merged.filter("kind = 'runs'").select("body", "counts").mapInPandas(_uppers, "node long, a long, b long, rest double").groupBy("node").agg(F.sum("a"), F.sum("b"), F.sum("rest")).collect()
    shared = spark.sparkContext.broadcast(upper_levels([tuple(r) for r in upper]))
    model = merged.select("part", "kind", "body", "counts").groupBy("part", "kind")
    asked = groups.select("part", "kind", "salt", "body").groupBy("part", "kind")
    told = model.cogroup(asked).applyInPandas(_valued(shared), "part int, kind string, salt long, body binary, value binary")
    keys = ["part", "kind", "salt"]
    values = told.groupBy(*keys).cogroup(salted.groupBy(*keys)).applyInPandas(_dealt, "chunk long, part int, kind string, value binary")
    chunks = gathered.filter("kind = 'text'").select("chunk", "ids", "out", "sizes", "body")
    got = chunks.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInPandas(_documents(parts, train_tokens, n_train, distinct + (n_train > 0)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
