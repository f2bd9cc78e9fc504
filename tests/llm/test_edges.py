"""Every corpus operator and pipeline stage over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import datetime as dt
import gzip
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from rampwise.llm import ann, bpe, decontam, langid, licenses, linededup, lm, minhash, quality, warc

#: Names that operators use inside, and names with dots.
EXTRA = ["_lost", "_all", "_id", "_hash", "_decontam", "_quality", "_lines", "lost", "lines", "decontam", "quality", "row", "key", "hash", "id", "node", "a.b", "licenses", "line_dedup", "found", "language"]


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdef')}{rng.randrange(500)}" for _ in range(n))


LONG = "\n".join(words(40, k) for k in range(2500))
RUN = "\n".join(words(20, 90_000 + k) for k in range(3))
TEXTS = [None, "", " \n\t ", "one", words(60, 1), words(60, 1), LONG, f"{words(9, 5)}\n{RUN}\n{words(9, 6)}", f"{words(9, 7)}\n{RUN}", "é ü ß 漢字 \u0000 end", words(12, 77), "Licensed under the Apache License, Version 2.0."]
ITEMS = [(1, words(12, 77)), (2, None), (None, words(11, 78)), (3, "short item"), (3, "short item"), (4, "")]


@pytest.fixture(scope="module")
def rows():
    own = [(k, t) for k, t in enumerate(TEXTS, 1)]
    return [*own, own[4], (None, words(60, 1)), (None, None), (5, "another text of the same id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en" if k % 2 else "de", None, None, *EXTRA) for k, (i, t) in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and benchmark as the pipeline reads them."""
    at = tmp_path_factory.mktemp("tables")
    labels = [(k, int(k % 3 > 0), 0) for k in range(1, 13)] + [(5, 0, 0), (None, 1, 0), (6, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, folder, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got, empty = run(spark, docs, folder), run(spark, none, folder)
    kept = got.collect()
    assert empty.count() == 0 and empty.columns == got.columns
    if stage != "tokens":
        assert got.columns == docs.columns
        assert all(list(r)[5:] == EXTRA for r in kept)
    texts = {(r.doc_id, r.text) for r in kept} if stage != "tokens" else None
    if stage == "line dedup":
        assert (8, TEXTS[7]) in texts and (9, words(9, 7)) in texts and (None, None) in texts and (2, "") in texts
        assert (None, TEXTS[4]) in texts and not {(5, TEXTS[4]), (6, TEXTS[4])} & texts  # null ids come first, repeated rows share their fate
    if stage == "near duplicates":
        assert {i for i, _ in texts} == {None, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12} and len(kept) == 15
    if stage == "decontamination":
        assert {i for i, _ in texts} == {None, 1, 2, 3, 4, 5, 6, 8, 9, 10, 12} and len(kept) == 14  # the long text holds the lines of two items
    if stage == "tokens":
        want = sorted((r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.decoded_sha256) for r in kept) == want


def test_info_columns_replace_those_of_their_name(spark, docs, none, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    model, lids = licenses.fit(docs), langid.fit(docs)
    for name, run in (("line_dedup", linededup.dedup_lines), ("found", lambda d: decontam.find(d, items)), ("licenses", lambda d: licenses.scan(d, model)), ("language", lambda d: langid.predict(d, lids))):
        got = run(docs)
        assert sorted(got.columns) == sorted(docs.columns)
        assert len(got.select(name).collect()) == len(rows)
        assert run(none).count() == 0
    found = {r.doc_id: r.found for r in decontam.find(docs, items).collect() if r.doc_id}
    assert found[11].item_ids == ["1"] and found[11].n_hit == 12 and found[1].n_words == 0 and found[7].n_words == 100_000
    held = {r.doc_id: [x.family for x in r.licenses.found] for r in licenses.scan(docs, model).collect() if r.doc_id}
    assert held[12] == ["Apache-2.0"] and not any(v for k, v in held.items() if k != 12)
    spoken = {r.doc_id: r.language.lang_pred for r in langid.predict(docs, lids).collect() if r.doc_id}
    assert spoken[1] == spoken[2] == spoken[3] == "und" and {spoken[k] for k in (4, 5, 7)} <= {"en", "de"}


def test_models_without_training_rows(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, empty)
    assert {round(r[0], 6) for r in docs.select(quality.quality(model, docs)).collect()} == {0.5}
    assert {r.language.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
    assert licenses.scan(docs, licenses.fit(none)).count() == docs.count()
    assert lm.score(none).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_bpe_against_tiktoken(spark, docs, rows):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(spark, path)
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = {t.name for t in spark.catalog.listTables()}
    got = bpe.decode(bpe.encode(docs, ranks, P.PATTERN, chunk_bytes=1000), ranks)
    want = sorted((i is not None, i or 0, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == want
    assert {t.name for t in spark.catalog.listTables()} == before


def test_warc_of_equal_names_in_two_folders(spark, tmp_path):
    page = "p" * 2000

    def arc(pages):
        body = b"1 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
        out = b"filedesc://a.arc 0.0.0.0 20200101000000 text/plain %d\n" % len(body) + body
        for url, content in pages:
            out += b"\n%s 1.2.3.4 20200102030405 text/html %d\n" % (url.encode(), len(content)) + content
        return out

    http = lambda i, text: b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" % i + text.encode()
    for k, name in enumerate(("one", "two")):
        at = tmp_path / "arc" / name
        at.mkdir(parents=True)
        data = arc([("http://x/", http(k, page)), ("dns:x", b"20200102 x 1.2.3.4"), ("http://y/", http(10 + k, "small"))])
        (at / "same.arc.gz").write_bytes(gzip.compress(data))
    broken = arc([("http://z/", http(20, "z"))]) + b"no header line at all\nhttp://w/ 1.2.3.4 never text/html 5\n" + b"\nhttp://v/ 1.2.3.4 20200102030405 text/html %d\n" % len(http(21, "v")) + http(21, "v")
    (tmp_path / "arc" / "plain.arc").write_bytes(broken)
    records = warc.arc_records(spark, f"file://{tmp_path}/arc").collect()
    assert len({r.record_id for r in records}) == len(records) == 11
    assert sorted(r.type for r in records) == ["resource"] * 2 + ["response"] * 6 + ["warcinfo"] * 3
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    back = warc.read_warc(spark, f"file://{tmp_path}/warc")
    assert sorted(r.type for r in back.collect()) == ["resource"] * 2 + ["response"] * 5 + ["revisit"] + ["warcinfo"] * 3
    assert {bytes(r.payload) for r in back.collect() if r.type == "resource"} == {b"20200102 x 1.2.3.4"}
    assert {r.date for r in back.collect() if r.type == "response"} == {"2020-01-02T03:04:05Z"}
    got = {r.page_id: tuple(r)[1:] for r in warc.resolved(back).collect()}
    sha1 = hashlib.sha1(page.encode()).hexdigest()
    assert got[0] == (2000, sha1, "revisit", 1) and got[1] == (2000, sha1, "response", None) and set(got) == {0, 1, 10, 11, 20, 21}


def test_warc_of_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a b/\n", ""), (None, "x", "q" * 1500), (3, "y", "q" * 1500), (3, "y", "q" * 1500), (4, "z", "r" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "k", "h") for r in rows], "page_id long, url string, html string, type string, `a.b` string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    sha1 = lambda t: hashlib.sha1(t.encode()).hexdigest()
    q = sha1("q" * 1500)
    want = [(1, 0, sha1(""), "response", None), (2, 0, sha1(""), "response", None), (3, 1500, q, "response", None), (3, 1500, q, "revisit", 3), (4, 3_000_000, sha1("r" * 3_000_000), "response", None), (None, 1500, q, "revisit", 3)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [2.0, 0.0]), (100, [3.0, 0.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(vectors, vectors.filter("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 7, 1.0), (0, 3, 100, 2.0), (100, 1, 7, 1.0), (100, 2, 0, 2.0), (100, 3, 1, 2.0)]


def test_recall_over_many_lists(spark):
    x = np.random.RandomState(5).normal(size=(50_000, 64))
    vectors = spark.createDataFrame(list(zip(range(len(x)), x.tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(8)
    asked = list(range(0, len(x), 500))
    hits = {q: set() for q in asked}
    for r in ann.search(vectors, vectors.filter("vec_id % 500 = 0")).collect():
        hits[r.query_id].add(r.vec_id)
    total = 0
    for q in asked:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        total += len(hits[q] & set(np.argsort(d)[:10].tolist()))
    assert total >= 0.9 * 10 * len(asked)


def test_language_model_of_odd_rows(docs, rows):
    got = lm.score(docs).collect()
    assert len(got) == len(rows) and sum(r.n_tokens == 1 for r in got) == 4
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_near_duplicates_of_odd_rows(docs, none, rows):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert minhash.near_duplicates(none).count() == 0


def test_times_are_kept():
    assert warc.header_url("http://a b/") == "http://a%20b/" and dt.datetime.fromisoformat("2020-01-02T03:04:05Z")
