"""Language identification by averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

A text is its words' byte n-grams (2 to 4 bytes, the space before and after a word included, A-Z lower-cased, every other
ASCII byte taken as a space). Each n-gram has an embedding by its hash; the mean of a text's embeddings goes through a
linear layer and a softmax. The model is learned from a bounded sample of labelled texts, ``per_language`` of each
language: each with its whole text and with a few short pieces of it. A held-back part of the sample sets the temperature
of the softmax and the score below which a prediction is rejected (``accepted`` is false).

Texts of any length are looked up by stripes that overlap, in training and prediction alike, so that their n-grams don't depend on where a stripe ends.

Prediction sends the model (buckets x languages numbers) to all executors and reads every whole text once, without a
shuffle. Null texts and texts without a letter get `und`, score 0, not accepted; so do all texts where nothing was learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampwise.llm.common import column

BUCKETS, DIM, EPOCHS = 1 << 14, 16, 6
#: The most texts of each language that the model is learned from.
PER_LANGUAGE = 600
#: The share of right predictions of the held-back part that stays accepted.
ACCEPT = 0.99
#: Bytes of a text that are looked up at a time.
STRIPE = 1 << 16

_TO = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def stripes(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, with repetitions, by stripes of the bytes at which they begin: each stripe looks three bytes ahead, so that none is lost or made at a seam."""
    for i in range(0, len(text) + 2, STRIPE):
        own = text[max(0, i - 1) : i + STRIPE + 2]
        b = np.full(min(len(text) + 2, i + STRIPE + 3) - i, 32, np.uint32)
        at = 1 if i == 0 else 0
        b[at : at + len(own)] = _TO[np.frombuffer(own, np.uint8)]
        word, gram = b != 32, b
        for n in (2, 3, 4):
            size = min(len(b) - n + 1, STRIPE)
            if size < 1:
                break
            gram = (gram[:size] << np.uint32(8)) | b[n - 1 : n - 1 + size]
            if n == 2:
                some = word[:size] | word[1 : size + 1]
            else:  # what lies between the first and the last byte has to be of one word
                some = word[1 : size + 1] if n == 3 else word[1 : size + 1] & word[2 : size + 2]
            yield ((gram[some] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def subwords(text: bytes) -> np.ndarray:
    """The buckets of all n-grams of a text, with repetitions."""
    return np.concatenate([np.zeros(0, np.uint32), *stripes(text)])


def has_letter(text: bytes) -> bool:
    if text.translate(None, _NOT_ASCII_LETTERS):
        return True
    return not text.isascii() and any(map(str.isalpha, str(text, "utf-8", "replace")))


_NOT_ASCII_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def pieces(text: bytes, seed: int) -> list[bytes]:
    """The whole text, and short pieces of it."""
    words, random = text.split(), np.random.RandomState(seed & 0x7FFFFFFF)
    out = [text]
    for n in (2, 4, 8, 16):
        if len(words) > n:
            at = random.randint(0, len(words) - n + 1)
            out.append(b" ".join(words[at : at + n]))
    return out


def _samples(frames):
    for pdf in frames:
        rows = []
        for seed, lang, text in zip(pdf["seed"], pdf["lang"], pdf["text"], strict=True):
            for piece in pieces(text, int(seed)):
                if has_letter(piece):
                    bucket, n = np.unique(subwords(piece), return_counts=True)
                    rows.append((int(seed), lang, bucket.astype("<u2").tobytes(), (n / n.sum()).astype("<f4").tobytes()))
        yield pd.DataFrame(rows, columns=["seed", "lang", "bucket", "share"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """``langs``, the table of each bucket's part of the logits, the bias, the temperature and the least accepted score."""

    def __init__(self, rows: list[tuple]):
        self.langs = sorted({r[1] for r in rows})
        self.table, self.bias, self.temperature, self.least = np.zeros((BUCKETS, max(1, len(self.langs))), np.float32), np.zeros(max(1, len(self.langs))), 1.0, 0.0
        if not self.langs:
            return
        random = np.random.RandomState(7)
        data = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(s, "<f4"), self.langs.index(lang), int(seed)) for seed, lang, b, s in rows]
        kept = [d for d in data if d[3] % 5] or data
        back = [d for d in data if d[3] % 5 == 0] or data
        E = random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        W = np.zeros((DIM, len(self.langs)), np.float32)
        steps, at = EPOCHS * len(kept), 0
        for _ in range(EPOCHS):
            for k in random.permutation(len(kept)):
                bucket, share, y, _ = kept[k]
                rate, at = 2.0 * (1 - at / steps), at + 1
                h = share @ E[bucket]
                g = softmax(h @ W + self.bias)
                g[y] -= 1
                g = g.astype(np.float32)
                back_h = np.clip(W @ g, -1, 1)  # clipped steps and bounded weights: a long run of hard texts can't make them diverge
                W = np.clip(W - rate * 0.5 * np.outer(h, g), -4, 4)
                self.bias -= rate * 0.1 * g
                E[bucket] = np.clip(E[bucket] - (rate * 20.0) * share[:, None] * back_h, -4, 4)
        self.table = (E @ W).astype(np.float32)
        logits = np.array([s @ self.table[b] + self.bias for b, s, _, _ in back])
        truth = np.array([d[2] for d in back])
        fits = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 4, 33)}
        self.temperature = float(min(fits, key=fits.get))
        p = softmax(logits / self.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        self.least = float(np.quantile(right, 1 - ACCEPT)) if len(right) else 0.0

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0, False
        total, n = np.zeros(len(self.langs)), 0
        for found in stripes(text):  # so that a text of any length takes bounded memory
            total += self.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        p = softmax((total / max(n, 1) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.least)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the labelled rows of ``docs``: ``per_language`` of each language at most, chosen by the hash of id and text length.

    A language's count sets the hash above which its rows are out at once, so that about four times ``per_language`` rows meet
    in the task of a language however many it has. The counts are broadcast: one row for each language, as in the model.
    """
    own = docs.select(F.abs(F.xxhash64(column(id_col), F.length(column(text_col)))).alias("seed"), column(lang_col).alias("lang"), column(text_col).cast("binary").alias("text")).filter("lang is not null and length(text) > 0")
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    least = F.lit(float(1 << 63)) * F.lit(4.0 * per_language) / F.col("n")
    own = own.join(F.broadcast(counts), "lang").filter(F.col("seed") <= least).select("seed", "lang", "text")
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("seed", "text"))).filter(F.col("k") <= per_language)
    sample = ranked.select("seed", "lang", "text").mapInPandas(_samples, "seed long, lang string, bucket binary, share binary")
    return Model(sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in sample.collect())))


def predict(docs: DataFrame, model: Model, text_col: str = "text", to: str = "language") -> DataFrame:
    """``docs`` with a struct ``to``, which replaces a column of that name: lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return docs.select(*(column(c) for c in docs.columns if c.lower() != to.lower()), language(column(text_col).cast("binary")).alias(to))
