"""Fill-in-the-middle transformation of documents by an index of distinct texts.

1. Documents are dealt out by a hash of their text and sorted by it, so that identical texts lie side by side; each is compared
   with the texts of its run byte by byte, so that texts that only share the hash are never taken for one. The whole
   text moves once. Texts with more than ``MOST_COPIES`` copies are spread over several tasks: the 1024 commonest hashes are looked
   up (a table of at most 1024 rows is broadcast); every other hash has less than a thousandth of all rows.
2. A distinct text's code point boundaries (their byte offsets) are listed once, in Elias-Fano form: unary high parts with a
   directory of counts, and packed low parts. A spread text is listed once in each of its tasks.
3. Every copy is joined to the list of its run; its two seeded cuts are look-ups in it (``select``), which give the bytes
   at which the text is cut.

The cuts of a document depend on its id and the seed only: h1 to h4 are the first four groups of eight digits of the hex
sha256 of ``seed:id``. Null texts are empty ones; a null id counts as an empty one in that hash; rows that repeat an id are cut
each by its own length. Empty texts and those that hold a marker stay plain. Other columns, of any name, play no part.
An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import column

#: Copies of a text that may meet in one task before it is spread, and the most texts that are spread.
MOST_COPIES, MOST_SPREAD = 512, 1024
#: Bytes of a text whose boundaries are listed at a time.
STRIPE = 1 << 22
MARKS = ("<P>", "<S>", "<M>")


class Boundaries:
    """The byte offsets of all code point boundaries of a UTF-8 text (its two ends included), in Elias-Fano form."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8)
        stripes = [(b[i : i + STRIPE] & 0xC0) != 0x80 for i in range(0, len(b), STRIPE)]
        self.n = int(sum(s.sum() for s in stripes))
        self.low_bits = max(0, (len(b) // (self.n + 1)).bit_length() - 1)
        high = np.zeros(-(-((len(b) >> self.low_bits) + self.n + 1) // 64) * 64, bool)
        low = np.zeros((self.n + 1) * self.low_bits, bool)
        done = 0
        for k, starts in enumerate([*stripes, None]):
            at = np.flatnonzero(starts) + k * STRIPE if starts is not None else np.array([len(b)])
            nth = np.arange(done, done + len(at))
            high[(at >> self.low_bits) + nth] = True
            for j in range(self.low_bits):
                low[nth * self.low_bits + j] = at >> j & 1
            done += len(at)
        self.high = np.packbits(high, bitorder="little").view("<u8")
        self.low = np.packbits(low, bitorder="little")
        self.until = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte offsets of the boundaries numbered ``k``, from 0."""
        word = np.searchsorted(self.until, k, side="right")
        bits = np.unpackbits(self.high[word].view(np.uint8).reshape(len(k), 8), axis=1, bitorder="little")
        nth = k - np.where(word > 0, self.until[word - 1], 0)
        place = (np.cumsum(bits, axis=1) > nth[:, None]).argmax(axis=1)
        out = word * 64 + place - k
        for j in reversed(range(self.low_bits)):
            at = k * self.low_bits + j
            out = out << 1 | self.low[at >> 3] >> (at & 7) & 1
        return out


def _cut(marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def run(frames):
        key, lists = None, {}
        for pdf in frames:
            rows = []
            for i, h, text, h1, h2, plain, spm in zip(*(pdf[c].tolist() for c in ("doc_id", "key", "text", "h1", "h2", "plain", "spm")), strict=True):
                if h != key:
                    key, lists = h, {}
                if text not in lists:
                    lists[text] = Boundaries(text)
                own = lists[text]
                cuts = sorted((h1 % (own.n + 1), h2 % (own.n + 1)))
                if plain:
                    rows.append((i, own.n, "plain", None, None, text))
                    continue
                a, b = own.select(np.array(cuts)).tolist()
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                out = (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)
                rows.append((i, own.n, "spm" if spm else "psm", cuts[0], cuts[1] - cuts[0], b"".join(out)))
            got = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            yield got.astype({"doc_id": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The three markers, none of which overlaps itself or another: only then can each be found again in any text without them."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("markers overlap, are equal or empty")
    return marks


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``plain`` of 100 documents stay as they are; of the others ``spm`` of 100 have the suffix first. ``n``, ``prefix_chars`` and
    ``middle_chars`` count code points.
    """
    spark, marks = docs.sparkSession, checked(marks)
    own = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    common = own.groupBy("key").count().filter(F.col("count") > MOST_COPIES).orderBy(F.desc("count"), "key").limit(MOST_SPREAD).collect()
    spread = F.broadcast(spark.createDataFrame([(k, -(-n // MOST_COPIES)) for k, n in common], "key long, pieces long"))
    piece = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.coalesce("pieces", F.lit(1).cast("long")))
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    kept = (F.col("text") == "") | (h[2] % 100 >= 100 - plain)
    for x in marks:
        kept = kept | F.contains("text", F.lit(x))
    dealt = own.join(spread, "key", "left").select("doc_id", "key", piece.alias("piece"), F.col("text").cast("binary").alias("text"), h[0].alias("h1"), h[1].alias("h2"), kept.alias("plain"), (h[3] % 100 < spm).alias("spm"))
    dealt = dealt.repartition("key", "piece").sortWithinPartitions("key", "piece")
    got = dealt.mapInPandas(_cut(marks), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return got.withColumn("output", F.col("output").cast("string"))


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which ``fill_in_middle`` made ``output`` in the form ``form``."""
    p, s, m = checked(marks)
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    at = {x: F.instr(output, x) for x in marks}

    def between(a: str, b: str | None) -> Column:
        begin = at[a] + len(a)
        return F.substr(output, begin, (at[b] - begin) if b else F.length(output))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
