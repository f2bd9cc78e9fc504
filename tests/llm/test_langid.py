"""The n-grams of a text don't depend on the stripes in which it is read."""

import random

import numpy as np
import pytest

from rampwise.llm import langid


def direct(text):
    b = bytes([32]) + bytes(langid._TO[c] for c in text) + bytes([32])
    out = []
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            g = b[i : i + n]
            if (g.strip() if n == 2 else b" " not in g[1:-1]) and g.strip():
                x = int.from_bytes(g, "big") ^ (n * 0x9E3779B1 & 0xFFFFFFFF)
                out.append((x * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - langid.BUCKETS.bit_length() + 1)
    return sorted(out)


@pytest.mark.parametrize("stripe", [1, 2, 3, 5, 64, 1 << 16])
def test_stripes(monkeypatch, stripe):
    monkeypatch.setattr(langid, "STRIPE", stripe)
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 6, 7, 63, 64, 65, 300):
        text = "".join(rng.choice("abZé  .\n") for _ in range(n)).encode()
        assert sorted(langid.subwords(text).tolist()) == direct(text)


def sample(seed, lang, text):
    bucket, n = np.unique(langid.subwords(text.encode()), return_counts=True)
    return seed, lang, bucket.astype("<u2").tobytes(), (n / n.sum()).astype("<f4").tobytes()


def test_long_texts_score_as_their_n_grams_say():
    model = langid.Model([sample(k, *r) for k, r in enumerate([("a", "the cat sat on the mat"), ("b", "der hund lief in den wald")] * 20)])
    text = ("the cat sat on " * 20_000).encode()
    found = langid.subwords(text)
    p = langid.softmax((model.table[found].sum(axis=0, dtype=float) / len(found) + model.bias) / model.temperature)
    assert np.isclose(model.predict(text)[1], p.max(), atol=1e-9) and model.predict(text)[0] == "a"
