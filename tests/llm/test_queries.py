"""The registered queries on the smallest table against brute-force versions."""

import hashlib
from collections import defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest

from rampwise.llm import licenses, queries

SF = "/root/testdata/sf0.001"
#: For what is learned.
LARGER = "/root/testdata/sf0.01"


def rows(table, columns, folder=SF):
    return duckdb.sql(f"select {columns} from '{folder}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return {i: t or "" for i, t in rows("documents", "doc_id, text")}


def lower(text):
    return text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def test_warc(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(con.sql(queries.OP1_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op1_warc(spark, SF).collect()) == want


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    linked = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = components(docs, linked)
    assert {tuple(r) for r in queries.op3_minhash(spark, SF).collect()} == {(i, len(sets[i]), part[i], part[i] == i) for i in docs}


def test_decontamination(spark, docs):
    import re

    cut = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = defaultdict(set)
    for i, t in rows("benchmark", "item_id, text"):
        w = cut(lower(t or ""))
        for k in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[k : k + 10])].add(str(i))
    want = set()
    for i, t in docs.items():
        w, hit, items = cut(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= own
        want.add((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    assert {tuple(r) for r in queries.op5_decontam(spark, SF).collect()} == want


def test_nearest_neighbours(spark):
    own = rows("embeddings", "vec_id, embedding")
    ids, x = np.array([r[0] for r in own]), np.array([r[1] for r in own], float)
    got = defaultdict(list)
    for r in sorted(queries.op6_ann(spark, SF).collect()):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((ids, d)) if k != q][:10]
        found = got[int(ids[q])]
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len(found) == 10
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        where = {int(i): k for k, i in enumerate(ids)}
        assert all(abs(d[where[v]] - s) < 1e-9 for _, v, s in found)
        hits += len({int(ids[k]) for k in best} & {f[1] for f in found})
        total += 10
    assert hits / total >= 0.9


def test_bpe(spark, docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t in docs.items():
        ids = enc.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in queries.op9_bpe(spark, SF).collect()} == want


def test_language_model_beats_the_word_counts(spark):
    out = [r for r in queries.op7_lm(spark, LARGER).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_quality_and_languages_on_held_out_rows(spark):
    truth = dict(rows("labels", "doc_id, quality", LARGER))
    got = [(r.predicted, truth[r.doc_id]) for r in queries.op2_quality(spark, LARGER).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(a == b for a, b in got) >= 0.85 * len(got)
    lang = dict(rows("documents", "doc_id, lang", LARGER))
    got = [(r.lang_pred, lang[r.doc_id]) for r in queries.op4_langid(spark, LARGER).collect() if r.held_out and r.lang_pred != "und" and lang[r.doc_id]]
    assert sum(a == b for a, b in got) >= 0.9 * len(got)


def test_licences(spark, docs):
    import re

    names = {"MIT": "MIT", "Apache": "Apache-2.0", "GNU": "GPL-3.0", "BY-NC": "CC-BY-NC"}
    want = {i: ",".join(sorted({v for x in re.findall(r"[^\n]*[Ll]icense[^\n]*", t) for k, v in names.items() if k in x})) for i, t in docs.items()}
    assert {r.doc_id: r.families for r in queries.op8_licenses(spark, SF).collect()} == want
    model = licenses.Model([b"some other words of a page", b"weather and news of today"] * 20)
    assert model.scan([b"", b"\n\n", b"the licence of a poet is large and wide"])[2]["found"] == []


def repeated(docs, least):
    """Lines of later copies of maximal repeated runs of ``least`` words or more, by comparing all pairs of places."""
    lines = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.strip()] for i, t in docs.items()}
    places = defaultdict(list)
    for i in sorted(lines):
        for p, (_, x) in enumerate(lines[i]):
            places[x].append((i, p))
    gone = defaultdict(set)
    for own in places.values():
        for a in own:
            for b in own:
                if a < b:
                    n, words = 0, 0
                    while a[1] + n < len(lines[a[0]]) and b[1] + n < len(lines[b[0]]) and lines[a[0]][a[1] + n][1] == lines[b[0]][b[1] + n][1]:
                        words += max(1, len(lines[b[0]][b[1] + n][1].split()))
                        n += 1
                    if words >= least:
                        gone[b[0]].update(range(lines[b[0]][b[1]][0], lines[b[0]][b[1] + n - 1][0] + 1))
    return gone


def test_line_runs(spark, docs):
    gone = repeated(docs, 25)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}
    got = {r.doc_id: r.text for r in queries.op10_linededup(spark, SF).collect()}
    assert got == want


