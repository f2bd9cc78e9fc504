"""Near duplicates: repeated ids, hubs, ties at exactly the threshold, resembling documents, against all pairs by brute force."""

import random
import re

import pytest

from rampwise.llm import minhash


def components_of(rows, words, percent):
    """(doc_id, n_shingles, component_id, kept) of each row, by comparing all pairs of documents, where a document is all rows of one id."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(words, len(w))
        return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [(i, s) for i, s in set(sets) if s and i is not None]
    for x, (i, a) in enumerate(own):
        for j, b in own[x + 1 :]:
            if 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    part = [find(i) if i is not None and s else i for i, s in sets]
    return sorted(((i, len(s), p, i is None or i == p) for (i, s), p in zip(sets, part, strict=True)), key=str)


def group(rng, n):
    """Near copies of one text that differ in 0 to 25 % of their words, as hubs with resembling documents around them."""
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    return [" ".join(f"x{rng.randrange(60)}" if rng.random() < share else w for w in base) for share in (rng.random() / 4 for _ in range(n))]


@pytest.mark.parametrize("words", [2, 5])
def test_groups_ties_and_repeated_ids(spark, monkeypatch, words):
    monkeypatch.setattr(minhash, "QUERY_BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(4)
    texts = group(rng, 150) + group(rng, 40)
    chain = [f"c{k}" for k in range(60)]
    texts += [" ".join(chain[k : k + 45]) for k in range(0, 16, 2)]
    # sets of 8 and 10 runs, 8 in common: exactly 80 %
    texts += [" ".join(f"t{k}" for k in range(words + 7)), " ".join(f"t{k}" for k in range(words + 9)), " ".join(f"t{k}" for k in range(words + 10))]
    texts += ["", None, " \n\t", "One", "one", "one two", "ONE TWO", texts[0], "é ü"]
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    rows += [(500, texts[3]), (500, texts[200]), (501, texts[200]), (501, texts[200]), (None, texts[3]), (None, None), (500, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(docs, words=words).collect()
    assert sorted((tuple(r) for r in got), key=str) == components_of(rows, words, 80)


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(30)) for w in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (6, c), (7, c), (8, ""), (8, None), (5, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == components_of(rows, 5, 80)
    assert (9, 26, 3, False) in got
    kept = {(r.doc_id, r.text) for r in minhash.one_of_each(docs).collect()}
    assert kept == {(3, a), (6, c), (8, ""), (8, None), (5, ""), (None, a)}
    assert minhash.one_of_each(docs).count() == sum(r[3] for r in got)


def test_empty_table_long_text_and_clashing_columns(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"v{k % 5003}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long, 1, 2, 3), (2, long + " end", 1, 2, 3), (3, "other", None, None, None)], "doc_id long, text string, lost int, `a.b` int, key int")
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r[0] for r in got.collect()) == [1, 3]
