"""A benchmark of many blocks finds what one block finds."""

import random
import re
import tracemalloc

from rampwise.llm import decontam


def test_blocks(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = [(f"item{k}", words(rng.choice([0, 3, 12, 40]))) for k in range(60)] + [("none", None), (None, words(12))]
    docs = [(k, " ".join([words(20), *(str(rng.choice(items)[1] or "") for _ in range(rng.randrange(3))), words(5)])) for k in range(80)] + [(80, None), (81, "")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = [{r.doc_id: (r.found.n_words, r.found.n_hit, r.found.item_ids, sorted(map(tuple, r.found.matches))) for r in decontam.find(docs, items, block_bytes=n).collect()} for n in (decontam.BLOCK_BYTES, 1000)]
    assert got[0] == got[1]
    assert sum(v[1] > 0 for v in got[0].values()) > 20


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items, window):
    """(n_words, n_hit, item_ids, spans) by looking for every window at every place."""
    w, hit, ids = words_of(doc), set(), set()
    for i, t in items:
        own = words_of(t)
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == own[k : k + n]:
                    hit |= set(range(at, at + n))
                    ids |= {i} - {None}
    return len(w), len(hit), sorted(ids)


def test_repetitive_texts(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("aab") for _ in range(n))
    items = [("", "a b a b a b"), ("x", "a " * 30), ("y", some(25)), ("y", some(8)), ("z", "b"), (None, some(12)), ("e", ""), ("n", None)]
    docs = [(k, some(rng.randrange(40))) for k in range(60)] + [(60, "a " * 50), (61, "A. a! a? a, a; a b"), (62, None), (63, "c " * 20)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for window, size in ((4, decontam.SHARD_BYTES), (10, 50)):
        for matches in (False, True):
            got = {r.doc_id: r.found for r in decontam.find(frame, bench, window=window, shard_bytes=size, matches=matches).collect()}
            for i, t in docs:
                assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == brute(t, items, window), (i, t)
                assert sum(s.length for s in got[i].spans) == got[i].n_hit and bool(got[i].matches) == (matches and got[i].n_hit > 0)


def test_long_repetitions_take_little_memory():
    own = decontam.Items([("r", b"w " * 20_000)], 10)
    tracemalloc.start()
    (got,) = decontam._shard([b"w " * 20_000], own, matches=False)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert got["start"] == [0] and got["span"] == [20_000] and got["met"] == ["r"]
