"""ARC records with spaces in their headers, texts that look like headers, unreadable headers and cut files."""

import gzip
import hashlib

import pytest

from rampwise.llm import warc

V1 = b"1 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
V2 = b"2 0 test\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def first(version):
    body = V1 if version == 1 else V2
    return b"filedesc://a.arc 0.0.0.0 20200101000000 text/plain " + (b"" if version == 1 else b"200 - - 0 a.arc ") + b"%d\n" % len(body) + body


def record(version, url, content, kind=b"text/html"):
    middle = kind + (b"" if version == 1 else b" 200 abc - 0 a.arc")
    return url + b" 1.2.3.4 20200102030405 " + middle + b" %d\n" % len(content) + content + b"\n"


@pytest.mark.parametrize("version", [1, 2])
def test_headers_with_spaces_and_texts_like_headers(version):
    fake = b"HTTP/1.1 200 OK\r\n\r\n<html>\nhttp://fake/ 9.9.9.9 20200101000000 text/html 5\nhello\n</html>"
    data = first(version) + record(version, b"http://a b/c d 1", fake) + record(version, b"http://x/", fake, b"text/html; charset=utf-8") + record(version, b"http://y/", b"")
    got = list(warc.parse_arc("f", data))
    assert [(r[0], r[4], r[7]) for r in got[1:]] == [("response", "http://a%20b/c%20d%201", "text/html"), ("response", "http://x/", "text/html; charset=utf-8"), ("resource", "http://y/", "text/html")]
    assert all(r[-1] == fake.partition(b"\r\n\r\n")[2] and r[6] == "2020-01-02T03:04:05Z" and not r[8] for r in got[1:3])


def test_unreadable_headers_keep_their_declared_content():
    inner = b"http://fake/ 9.9.9.9 20200101000000 text/html 5\nhello"
    data = first(1) + b"http://odd/ no date here text/html %d\n" % len(inner) + inner + b"\n" + record(1, b"http://y/", b"y")
    got = list(warc.parse_arc("f", data))
    assert [(r[0], r[-1]) for r in got] == [("warcinfo", V1), ("resource", inner), ("resource", b"y")]
    assert got[1][4].startswith("about:f#") and got[2][4] == "http://y/"
    # where no length is declared, the next line whose URL has a scheme goes on
    data = first(1) + b"junk\nrelative 1.2.3.4 20200102030405 text/html 3\nabc\n" + record(1, b"http://y/", b"y")
    assert [r[4] for r in warc.parse_arc("f", data)][1:] == ["http://y/"]
    assert list(warc.parse_arc("f", b"http://x/ 1.2.3.4 20200102030405 text/html 3\nabc")) != []
    assert list(warc.parse_arc("f", b"")) == []


def test_cut_files_and_hot_payloads(spark, tmp_path):
    page = lambda i, text: b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" % i + text.encode()
    (tmp_path / "arc").mkdir()
    for k in range(4):
        data = first(1 + k % 2) + b"".join(record(1 + k % 2, b"http://h/%d" % i, page(i, "c" * 1200 if i % 3 else f"{i}" * 1000)) for i in range(10 * k, 10 * k + 10))
        (tmp_path / "arc" / f"{k}.arc.gz").write_bytes(gzip.compress(data))
    whole = first(1) + record(1, b"http://cut/", page(99, "z" * 5000))
    (tmp_path / "arc" / "cut.arc").write_bytes(whole[:-2000])
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    records = warc.read_warc(spark, f"file://{tmp_path}/warc")
    got = {r.page_id: tuple(r)[1:] for r in warc.resolved(records).collect()}
    sha1 = lambda t: hashlib.sha1(t.encode()).hexdigest()
    for i in range(40):
        text = "c" * 1200 if i % 3 else f"{i}" * 1000
        assert got[i] == (len(text), sha1(text), "revisit" if i % 3 and i != 38 else "response", 38 if i % 3 and i != 38 else None)
    assert got[99] == (3001, sha1("z" * 3001), "response", None) and len(got) == 41
    heads = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz"))
    assert heads.count(b"WARC-Truncated: unspecified") == 1
