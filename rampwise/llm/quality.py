"""A quality classifier by gated-attention multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages (``PASSAGE`` bytes each). Every passage is encoded: hashed byte trigrams and a few shares
of character classes, through one layer. Learned gated attention weights add the passages up to one representation of the
document, which a logistic unit scores; only the documents' labels are needed. The model is learned with Adam on a bounded
sample of labelled rows (``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes of text at most), from all their passages. Of an id with several labels the smallest counts; of an
id with several texts each is a bag, rows that repeat are one.

Scoring sends the model to all executors (its size is fixed) and reads every whole text once, all passages of it, without
a shuffle. Null and empty texts are scored as one empty passage. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.llm.common import column

PASSAGE = 1024
HASHED, HIDDEN, GATE = 1024, 24, 12
#: The most labelled rows that the model is learned from.
SAMPLE = 4000
#: The most bytes of text that the model is learned from.
SAMPLE_BYTES = 64 << 20
EPOCHS, BATCH, RATE = 25, 32, 0.01
#: Passages encoded at a time.
STRIPE = 512

_CLASSES = np.zeros(256, np.int64)
for _low, _high, _class in ((0, 31, 1), (32, 32, 2), (33, 47, 3), (48, 57, 4), (58, 64, 3), (65, 90, 5), (91, 96, 3), (97, 122, 6), (123, 126, 3), (127, 127, 1), (128, 255, 7)):
    _CLASSES[_low : _high + 1] = _class
_CLASSES[10] = 0
#: Inputs of a passage: hashed trigrams, eight class shares, share of distinct trigrams, log length.
WIDTH = HASHED + 10


def features(passages: list[bytes]) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each passage."""
    n = len(passages)
    length = np.array([len(p) for p in passages], np.int64)
    b = np.frombuffer(b"".join(passages), np.uint8)
    row = np.repeat(np.arange(n), length)
    shares = np.bincount(row * 8 + _CLASSES[b], minlength=n * 8).reshape(n, 8) / np.maximum(length, 1)[:, None]
    out = np.zeros((n, WIDTH), np.float32)
    out[:, HASHED : HASHED + 8] = shares * 3
    out[:, HASHED + 9] = np.log1p(length) / 7
    if len(b) >= 3:
        x = b.astype(np.uint32)
        gram = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        own = row[:-2] == row[2:]
        gram, row = gram[own], row[:-2][own]
        slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
        counts = np.bincount(row * HASHED + (slot & (HASHED - 1)), minlength=n * HASHED).reshape(n, HASHED)
        out[:, :HASHED] = np.sqrt(counts / np.maximum(counts.sum(axis=1), 1)[:, None]) * 3
        out[:, HASHED + 8] = 3 * (counts > 0).sum(axis=1) / np.maximum(1, np.minimum(counts.sum(axis=1), HASHED))
    return out


def passages_of(text: bytes) -> list[bytes]:
    return [text[i : i + PASSAGE] for i in range(0, len(text), PASSAGE)] or [b""]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights: W, a the encoder; V, U, w the gated attention; c, d the score."""

    def __init__(self, seed: int = 5):
        random = np.random.RandomState(seed)
        make = lambda *s: random.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"W": make(WIDTH, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "V": make(HIDDEN, GATE), "U": make(HIDDEN, GATE), "w": make(GATE), "c": np.zeros(HIDDEN, np.float32), "d": np.zeros(1, np.float32)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"] + self.p["a"])

    def attend(self, h: np.ndarray, starts: np.ndarray) -> tuple:
        """Attention weights of the rows of ``h`` within the bags that begin at ``starts``, and what the gradient needs of the way there."""
        t, s = np.tanh(h @ self.p["V"]), sigmoid(h @ self.p["U"])
        e = (t * s) @ self.p["w"]
        size = np.diff(np.r_[starts, len(h)])
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        return e / np.repeat(np.add.reduceat(e, starts), size), t, s, size

    def score(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score of each bag of encoded passages."""
        a = self.attend(h, starts)[0]
        return sigmoid(np.add.reduceat(a[:, None] * h, starts) @ self.p["c"] + self.p["d"])

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        h = self.encode(x)
        a, t, s, size = self.attend(h, starts)
        z = np.add.reduceat(a[:, None] * h, starts)
        g = (sigmoid(z @ p["c"] + p["d"]) - y) / len(y)
        dz = np.repeat(g[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), size))
        dt, ds = de[:, None] * p["w"] * s, de[:, None] * p["w"] * t
        dt, ds = dt * (1 - t * t), ds * s * (1 - s)
        dh = a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "a": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}

    def train(self, bags: list[tuple[np.ndarray, int]], seed: int = 11) -> Model:
        random = np.random.RandomState(seed)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        total = EPOCHS * -(-len(bags) // BATCH)
        for _ in range(EPOCHS):
            order = random.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                own = [bags[k] for k in order[i : i + BATCH]]
                starts = np.cumsum([0, *(len(b) for b, _ in own[:-1])])
                g = self.gradient(np.concatenate([b for b, _ in own]).astype(np.float32), starts, np.array([y for _, y in own], np.float32))
                step += 1
                for k in self.p:
                    g[k] = g[k] + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - RATE * (1 - step / (total + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts; passages are encoded in stripes, so that the memory for a text of any length is small."""
        cut = [passages_of(t) for t in texts]
        starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
        flat = [p for c in cut for p in c]
        h = np.concatenate([self.encode(features(flat[i : i + STRIPE])) for i in range(0, len(flat), STRIPE)])
        return self.score(h, starts)


def _bags(frames):
    for pdf in frames:
        out = []
        for text in pdf["text"].tolist():
            own = passages_of(text or b"")
            out.append(b"".join(features(own[i : i + STRIPE]).astype(np.float16).tobytes() for i in range(0, len(own), STRIPE)))
        yield pd.DataFrame({"seed": pdf["seed"], "y": pdf["y"], "x": out})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", usable: Column | None = None, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of at most ``sample`` labelled rows, chosen by the hash of their id among those that are ``usable`` (a condition on labels), in that order as far as ``sample_bytes`` go."""
    own = labels if usable is None else labels.filter(usable)
    own = own.select(column(id_col).cast("long").alias("id"), column(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    chosen = own.groupBy("id").agg(F.min("y").alias("y")).select("id", "y", F.abs(F.xxhash64("id")).alias("seed")).orderBy("seed", "id").limit(sample)
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "id").select("seed", "y", "text", F.xxhash64("text").alias("hash"))
    sizes = texts.select("seed", "hash", F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct().orderBy("seed", "hash").limit(sample)
    upto = F.sum("n").over(Window.orderBy("seed", "hash").rowsBetween(Window.unboundedPreceding, 0))  # of ``sample`` rows at most
    kept = sizes.withColumn("upto", upto).filter(F.col("upto") <= sample_bytes).select("seed", "hash")
    texts = texts.join(F.broadcast(kept), ["seed", "hash"]).dropDuplicates(["seed", "hash"]).select("seed", "y", "text")
    rows = sorted((r[0], r[1], bytes(r[2])) for r in texts.mapInPandas(_bags, "seed long, y int, x binary").collect())
    model = Model()
    return model.train([(np.frombuffer(x, np.float16).reshape(-1, WIDTH), y) for _, y, x in rows]) if rows else model


def quality(model: Model, docs: DataFrame, text_col: str = "text") -> Column:
    """A column with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out, held, n = [], [], 0
        for t in texts:
            held.append(t if t is not None else b"")
            n += len(held[-1])
            if n >= 4 << 20:
                out.append(shared.value.score_texts(held))
                held, n = [], 0
        if held:
            out.append(shared.value.score_texts(held))
        return pd.Series(np.concatenate(out).astype(float) if out else np.zeros(0))

    return score(column(text_col).cast("binary"))
