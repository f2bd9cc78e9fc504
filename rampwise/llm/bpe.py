"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Every text is cut into pre-tokens. A chunk of documents (about ``CHUNK_BYTES`` of text) keeps the positions of its
   pre-tokens as codes into its own list of distinct words, and deals these words out to ``PARTS`` parts by a hash, a packed
   block for each part. All is written once to the shared folder.
2. The blocks are shuffled by part; there each distinct word is encoded once, by merging its bytes in the order of the
   vocabulary's ranks (on a cluster of more than twice ``PARTS`` shuffle partitions a part is cut into groups of chunks, and a word
   is encoded once in each). A word that is in every chunk is one entry of each block, so no part is larger than others.
3. The ids go back to their chunk, a packed block from each part, and each document is put together from them by position.

Decoding is a map-side join with the token-byte table, which is sent to all executors: the vocabulary has a fixed size. A row for
each token and a shuffle back to documents would move several times the text. Null and empty texts give no ids. Rows
that repeat are kept, each for itself; null ids are kept. Other columns play no part.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.llm.common import bucketed, by_bytes, id_text, ragged, small_batches

#: Text of about so many bytes makes a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: The most parts that a chunk's words are dealt out to.
PARTS = 256
#: The most words whose ids a task keeps.
CACHED = 1 << 20


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens, by a path that the driver or Spark can read."""
    lines = open(path, "rb").read().splitlines() if path.startswith("/") else [bytes(r[0], "ascii") for r in spark.read.text(path).collect()]
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank (the leftmost of equals) is joined until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 300:
        return merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    found = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
    while found and (low := min(found)) < 1 << 30:
        i = found.index(low)
        parts[i] += parts.pop(i + 1)
        found.pop(i)
        if i < len(found):
            found[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            found[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for very long pre-tokens in n log n: a heap of pairs over a linked list of parts."""
    import heapq

    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> tuple | None:
        j = nxt[i]
        rank = ranks.get(word[i : end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[i], end[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, mid, last = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != last:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = False, last, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for k in (i, prev[i]):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def planes(codes: np.ndarray) -> bytes:
    """Codes as three compressed byte planes."""
    import zstandard

    return zstandard.compress(b"".join(((codes >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)), 3)


def unplaned(packed: bytes) -> np.ndarray:
    import zstandard

    p = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    out = p[0].astype(np.uint32)
    for k in (1, 2, 3):
        if p[k].any():
            out |= p[k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_words(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 3)


def unpack_words(packed: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 * (n + 1)).tolist()
    return [raw[i:j] for i, j in zip([4 * (n + 1), *ends], ends, strict=False)]


def _chunks(pattern: str, chunk_bytes: int, parts: int):
    def run(frames):
        import zlib

        import regex
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24
        cut = regex.compile(pattern).findall
        for number, rows in enumerate(by_bytes(frames, chunk_bytes)):
            words: dict[str, int] = {}
            put, codes, counts = words.setdefault, [], []
            for _, text in rows:
                own = [put(w, len(words)) for w in cut(str(text, "utf-8", "replace"))]
                codes.append(np.array(own, np.uint32))
                counts.append(len(own))
            joined = np.concatenate(codes)
            del codes
            order = np.argsort(-np.bincount(joined, minlength=len(words)), kind="stable")  # frequent words get small codes
            new = np.empty(len(words), np.uint32)
            new[order] = np.arange(len(words), dtype=np.uint32)
            keys = [w.encode() for w in words]
            keys = [keys[k] for k in order]
            del words
            part = np.fromiter((zlib.crc32(k) % parts for k in keys), np.uint32, len(keys))
            out = [(first + number, -1, [None if pd.isna(i) else int(i) for i, _ in rows], counts, planes(new[joined]), planes(part))]
            by = np.argsort(part, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(part[by])) + 1) if len(by) else []:
                out.append((first + number, int(part[own[0]]), None, None, pack_words([keys[k] for k in own]), None))
            for at in range(0, len(out), 64):
                yield pd.DataFrame(out[at : at + 64], columns=["chunk", "part", "ids", "counts", "body", "dealt"])

    return run


def _encode_blocks(ranks):
    """The ids of each block's words, packed: how many each word has, and all of them."""

    def run(frames):
        table, cache = ranks.value, {}
        for pdf in frames:
            out = []
            for body in pdf["body"]:
                own = []
                for word in unpack_words(body):
                    ids = cache.get(word)
                    if ids is None:
                        if len(cache) >= CACHED:
                            cache.clear()
                        cache[word] = ids = merge(word, table)
                    own.append(ids)
                lengths = np.fromiter(map(len, own), np.uint32, len(own))
                out.append(planes(np.concatenate([lengths, np.fromiter((i for ids in own for i in ids), np.uint32, int(lengths.sum()))])))
            yield pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "packed": out})

    return run


def _reassemble(chunks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    if not len(chunks):
        return pd.DataFrame({"doc_id": pd.Series([], dtype="Int64"), "ids": []})
    row = chunks.iloc[0]
    dealt = unplaned(row["dealt"])
    order, sizes = np.argsort(dealt, kind="stable"), np.bincount(dealt)
    none, parts = [np.zeros(0, np.uint32)], []
    for part, packed in sorted(zip(words["part"], words["packed"], strict=True)):
        both = unplaned(packed)
        parts.append((both[: sizes[part]], both[sizes[part] :]))
    length, flat = (np.concatenate(none + [p[k] for p in parts]) for k in (0, 1))
    del parts
    starts, lengths = np.empty(len(dealt), np.int64), np.empty(len(dealt), np.int64)
    starts[order], lengths[order] = np.cumsum(length, dtype=np.int64) - length, length
    codes, out, at = unplaned(row["body"]), [], 0
    for n in row["counts"]:
        own = codes[at : at + n]
        at += n
        out.append(flat[ragged(starts[own], lengths[own])].astype("<u4", copy=False).tobytes())
    return pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in row["ids"]], dtype="Int64"), "ids": out})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(PARTS, partitions)
    schema = "chunk long, part int, ids array<long>, counts array<long>, body binary, dealt binary"
    chunks = bucketed(id_text(docs, id_col, text_col).mapInPandas(_chunks(pattern, chunk_bytes, parts), schema), "chunk", "bpe")
    group = F.pmod(F.xxhash64("chunk"), F.lit(max(1, partitions // parts))).alias("of")
    blocks = chunks.filter("part >= 0").select("chunk", "part", "body", group).repartition("part", "of").drop("of")
    encoded = blocks.mapInPandas(_encode_blocks(shared), "chunk long, part int, packed binary")
    whole = chunks.filter("part = -1").select("chunk", "ids", "counts", "body", "dealt")
    return whole.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInPandas(_reassemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for, from the token-byte table."""
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths))

    @F.pandas_udf("binary")
    def look_up(ids: pd.Series) -> pd.Series:
        flat, starts, sizes = shared.value
        return pd.Series([flat[ragged(starts[own], sizes[own])].tobytes() for own in (np.frombuffer(x, "<u4") for x in ids)])

    return encoded.withColumn(to, look_up(F.col(ids_col)))
