"""Line runs of many short lines, so that all rounds of prefix doubling take part, against all pairs of places."""

import random

import pytest

from rampwise.llm import linededup
from tests.llm.test_queries import repeated


def texts(rng, n, lines):
    """Texts of runs from a common stock among own lines, with blank lines, lines within one text repeated and some long lines."""
    word = lambda: f"w{rng.randrange(50)}"
    stock = [[" ".join(word() for _ in range(rng.choice([1, 1, 1, 2, 5, 30]))) for _ in range(rng.randrange(2, lines))] for _ in range(6)]
    out = []
    for _ in range(n):
        own = []
        for _ in range(rng.randrange(5)):
            run = rng.choice(stock)
            at = rng.randrange(len(run))
            own += run[at : at + rng.randrange(1, lines)] if rng.random() < 0.5 else run
            own += rng.choice([[], [""], ["same"] * rng.randrange(60), [" ".join(word() for _ in range(8))]])
        out.append("\n".join(own))
    return out


def blanks_between(lines, gone):
    """``gone``, and blank lines between two of them."""
    kept = [k for k, x in enumerate(lines) if x.strip()]
    return gone | {k for a, b in zip(kept, kept[1:]) if a in gone and b in gone for k in range(a, b)}


@pytest.mark.parametrize(("seed", "least"), [(1, 25), (3, 7), (4, 1)])
def test_short_lines(spark, seed, least):
    rng = random.Random(seed)
    docs = {i: t for i, t in enumerate(texts(rng, 60, 45)) if t}
    found = repeated(docs, least)
    gone = {i: blanks_between(t.split("\n"), found[i]) for i, t in docs.items()}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}
    assert any(gone.values())
    got = linededup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5), min_words=least)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_ranks_are_in_suffix_order(spark):
    docs = dict(enumerate(texts(random.Random(5), 40, 45)))
    own = linededup._lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text")
    names = {}
    for r in own.orderBy("id", "k").collect():
        names.setdefault(r.id, []).append(r.f0)
    shared = linededup.ranks(own, 25)
    assert len(shared) == 4
    for j, level in enumerate(shared, 1):
        got = sorted((r.f, names[r.id][r.k : r.k + (1 << j)]) for r in level.collect())
        assert all((a[0] == b[0]) == (a[1] == b[1]) and a[1] <= b[1] for a, b in zip(got, got[1:]))
