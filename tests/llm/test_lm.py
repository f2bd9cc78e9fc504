"""Context-tree weighting against a direct recursion over all contexts, and the base score against word counts."""

import math
from collections import Counter, defaultdict
from zlib import crc32

from rampwise.llm import lm

TEXTS = {0: "the cat sat on the mat", 1: "The cat sat\ton the hat. the cat", 2: None, 3: "", 4: "éàé été", 5: "zzz qqq", 6: "the mat the mat the mat", 7: "on the hat", 16: "sat sat sat", 40: "cat on mat " * 30, 41: "cat on mat " * 30}


def brute(rows):
    train = [i for i, _ in rows if i is not None and crc32(str(i).encode()) % 10]
    texts = [(i, (t or "").encode().translate(lm._LOWER)) for i, t in rows]
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, t in texts:
        if i not in train:
            continue
        s = b"\xff" * 5 + t + b"\xff"
        for k in range(5, len(s)):
            for bit in range(8):
                for d in range(6):
                    node = (s[k - d : k], bit, s[k] >> (8 - bit))
                    counts[node][s[k] >> (7 - bit) & 1] += 1
                    if d:
                        children[s[k - d + 1 : k], bit, s[k] >> (8 - bit)].add(node)
    weighted = {}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(node):
        if node not in weighted:
            own = kt(*counts[node])
            if len(node[0]) < 5:
                rest = sum(pw(c) for c in children[node])
                m = max(own, rest)
                own = m + math.log(math.exp(own - m) + math.exp(rest - m)) - math.log(2)
            weighted[node] = own
        return weighted[node]

    def p(s, k, bit):
        q, one = 0.5, s[k] >> (7 - bit) & 1
        for d in range(5, -1, -1):
            node = (s[k - d : k], bit, s[k] >> (8 - bit))
            if node not in counts:
                continue
            c = counts[node]
            own = (c[one] + 0.5) / (sum(c) + 1)
            child = d < 5 and (s[k - d - 1 : k], bit, s[k] >> (8 - bit)) in counts
            stay = math.exp(kt(*c) - pw(node) - math.log(2)) if child else 1
            q = stay * own + (1 - stay) * q
        return q

    words = Counter(w for i, t in texts if i in train for w in [*t.split(), "end"])
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in texts:
        s = b"\xff" * 5 + t + b"\xff"
        tokens = [*t.split(), "end"]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, i not in train, len(tokens), sum(words[w] > 0 for w in tokens), n, base, sum(math.log10(p(s, k, b)) for k in range(5, len(s)) for b in range(8))))
    return out


def same(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    got = sorted((tuple(r)[:7] for r in lm.score(frame, chunk_bytes=200, **options).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-9 and abs(g[6] - w[6]) < 1e-4, (g, w)


def test_scores_equal_a_direct_recursion(spark):
    same(spark, [*TEXTS.items(), (None, "the cat"), (7, "on the hat")])


def test_several_groups_of_chunks(spark):
    same(spark, [*TEXTS.items(), (None, "the cat"), (7, "on the hat")], group=1)


def test_tables_without_training_rows(spark):
    out = [i for i in range(200) if crc32(str(i).encode()) % 10 == 0][:2]
    same(spark, [(i, "some words here") for i in out])
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_log_gamma():
    import numpy as np

    n = np.array([0, 1, 100, 4095, 4096, 10**6])
    assert np.allclose(lm.log_gamma(n, lm._HALF, 0.5), [math.lgamma(x + 0.5) for x in n.tolist()], rtol=1e-12)
    assert np.allclose(lm.log_gamma(n, lm._ONE, 1.0), [math.lgamma(x + 1.0) for x in n.tolist()], rtol=1e-12)
