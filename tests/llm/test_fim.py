"""Fill-in-the-middle: boundary lists, cuts against Python's own strings, copies, markers, edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampwise.llm import fim


@pytest.mark.parametrize("stripe", [7, 1 << 22])
def test_boundaries_are_those_of_code_points(monkeypatch, stripe):
    monkeypatch.setattr(fim, "STRIPE", stripe)
    rng = random.Random(1)
    for alphabet in ("ab", "aé", "中文字", "a\U0001f600é中", "\U0001f600\U0001f601"):
        for n in (0, 1, 2, 63, 64, 65, 500):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            own = fim.Boundaries(text.encode())
            assert own.n == n
            assert own.select(np.arange(n + 1)).tolist() == [len(text[:k].encode()) for k in range(n + 1)]


def expected(i, text):
    t = text or ""
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, t)
    p, m, s = t[:a], t[a:b], t[b:]
    spm = h[3] % 100 < 20
    return (i, n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def test_cuts_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(fim, "MOST_COPIES", 8)
    rng = random.Random(2)
    copies = ["one text with many copies \U0001f600", "another é text"]
    texts = [rng.choice(copies) for _ in range(150)] + ["", None, "x", "<", "<P", "P>", "a<S>b", "<M>", "é" * 3, "x" * 100_000, "ab\x00c\n"]
    texts += ["".join(rng.choice("<PSM>aé中\U0001f600 ") for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "no id"), (None, None), (3, "again"), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame([(t, i, 1, 2) for i, t in rows], "text string, doc_id long, output int, `key.x` int").repartition(4)
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored("output", "form")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert sorted((r["back"] for r in got)) == sorted(t or "" for _, t in rows)


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(fim.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(i, f"text {i % 3} é") for i in range(60)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [expected(*r) for r in rows]


def test_empty_table_and_bad_markers(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "<M>"), ("aa", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.checked(marks)
