"""SimHash near-duplicates: fingerprints against a direct count, components against all pairs, dense groups, edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash

from rampwise.llm import simhash


def direct(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_are_counted_over_whole_texts(monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 16)
    rng = random.Random(3)
    for text in ["", " \n", "One", "One two THREE", "É é  x\ty\x0bz \xa0", *(" ".join(rng.choice(["a", "Bc", "é", "中文", "dd\x1c"]) for _ in range(n)) for n in (4, 5, 20, 300))]:
        assert simhash.fingerprint(text.encode()) == direct(text)


def parts(x, most):
    """Components of numbers by comparing all pairs."""
    label = np.arange(len(x))
    for i in range(len(x)):
        near = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= most)
        own = np.unique(label[near])
        label[np.isin(label, own)] = own.min()
    return label.tolist()


def clustered(rng, n, centres, flips):
    x = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(flips):
            y = c
            for _ in range(rng.randrange(7)):
                y ^= 1 << rng.randrange(64)
            x.add(y)
    return x


@pytest.mark.parametrize("most", [0, 4])
def test_links_of_one_index_and_of_two(monkeypatch, most):
    monkeypatch.setattr(simhash, "ASKED", 50)
    monkeypatch.setattr(simhash, "STEPS", 300)
    rng = random.Random(4)
    x = np.array(sorted(clustered(rng, 300, 6, 60)), np.uint64)
    x = x[np.argsort(simhash.ranked(x))]
    split = np.array([rng.random() < 0.4 for _ in x])
    pieces, joined = [np.flatnonzero(split), np.flatnonzero(~split)], []
    for own in pieces:
        i, j = simhash.close_links(x[own], None, most)
        assert len(i) < len(own)
        joined += zip(own[i].tolist(), own[j].tolist(), strict=True)
    i, j = simhash.close_links(x[pieces[0]], x[pieces[1]], most)
    both = np.r_[pieces[0], pieces[1]]
    joined += zip(both[i].tolist(), both[j].tolist(), strict=True)
    assert all(int(x[a] ^ x[b]).bit_count() <= most for a, b in joined)
    label = np.arange(len(x))
    for a, b in joined:
        label[label == max(label[a], label[b])] = min(label[a], label[b])
    assert label.tolist() == parts(x, most)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_SHARD", 40)
    monkeypatch.setattr(simhash, "MOST_SHARD", 40)
    rng = random.Random(6)
    x = sorted(clustered(rng, 500, 8, 80) | {0, (1 << 64) - 1, 15, 1 << 63})
    signed = [int(np.array([v], np.uint64).astype(np.int64)[0]) for v in x]
    nodes = spark.createDataFrame(list(zip(signed, range(len(x)), strict=True)), "fingerprint long, node long").repartition(4)
    got = simhash.components(simhash.links(nodes)).collect()
    label = list(range(len(x)))
    for n, c in got:
        label[n] = c
    assert label == parts(np.array(x, np.uint64), 4)


def test_documents_and_edges(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(300)}" for _ in range(150)] for _ in range(5)]
    texts = []
    for k in range(120):
        own = list(base[k % 5])
        for _ in range(rng.randrange(6)):
            own[rng.randrange(150)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(own).title() if k % 2 else " \n".join(own))
    texts += ["", None, "\t", "one", "One", "one two three", "y " * 50_000]
    rows = list(enumerate(texts, 10)) + [(10, texts[1]), (11, "one"), (None, texts[0]), (None, None), (12, texts[2]), (12, texts[2])]
    docs = spark.createDataFrame([(t, i, "c") for i, t in rows], "text string, doc_id long, component_id string").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    own = [(i, direct(t)) for i, t in rows]
    root = {i: i for i, _ in own if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in own:
        for j, b in own:
            if i is not None and j is not None and (a ^ b).bit_count() <= 4:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert got == sorted(((i, f, None if i is None else find(i)) for i, f in own), key=str)
    assert len({c for _, _, c in got}) < len(rows) - 30
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
