"""Conversion of legacy ARC archives to WARC.

ARC files begin with a version block (`filedesc://` line, version line, field line); the version tells which fields a record's
header line has, and its last field how many bytes of content follow. ``arc_records`` reads them by these declared lengths. Header lines are read from their
right end (length, then date), since URLs and content types may hold spaces;
``convert`` synthesises WARC identifiers (name-based UUIDs of file and offset), timestamps, record types and payload
digests and writes WARC 1.1; ``read_warc`` reads such archives back by their content lengths. ``write_arc`` makes ARC files
of either version from a table of pages.

Archives are written by Spark's own file writer and read with its binary file source, so any store that Spark reaches
will do, and lost tasks are run again by Spark. Files are compressed as a whole (not each record) and unpacked as a stream;
ARC files may be uncompressed.

The version block becomes a ``warcinfo`` record, content that begins with an HTTP status line a ``response``, other content (as that
of ``dns:`` URLs) a ``resource`` with its own content type. Where a header line of the file's version should stand but doesn't, a line that ends in a
number is taken for a header that can't be read: as many bytes are kept as a ``resource`` under a URL made of the file and the offset, and never searched for header lines.
Any other such line is passed over, with all lines up to the next header line whose URL has a scheme. A record shorter than declared, at the end of a cut file, is kept and marked
as truncated. Record ids come from the whole path of the file and the offset.

Archives are parsed twice: once for digests and places only, from which it is decided what is a revisit, and once to be written. The decisions of a
file go to the file as a list; payloads move with their compressed files, if at all, and never by their digest, so that a payload
with many copies is no hot key.

Records whose payloads have at least ``least`` bytes and equal digest and length are one group: the record of the largest
page id (of equals, the largest record id) is the response, the others become revisit records that carry their HTTP
header only and refer to it. Null payloads are empty; null page ids sort below all others and come back as null; null or
odd URLs are percent-encoded so that they fit a header line; repeated rows are records of their own; an empty table gives
archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.llm.common import column, scratch_path, written

#: Fixed values of the ARC format: the fields of a record's header line, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_FROM = 1000
ID_HEADER = "X-Page-Id"
#: Header lines from the right: URL, address, date, content type, further fields, length.
HEADERS = {1: re.compile(r"(.*) (\S+) (\d{8,17}) (?:(.*) )?(\d+)"), 2: re.compile(r"(.*) (\S+) (\d{8,17}) (.*) \S+ \S+ \S+ \d+ \S+ (\d+)")}
SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:")
LIGHT_SCHEMA = "type string, file string, offset long, version int, url string, ip string, date string, content_type string, truncated boolean, page_id long, record_id string, sha1 string, sha1_base32 string, bytes long"
ARC_SCHEMA = f"{LIGHT_SCHEMA}, head binary, payload binary"
DECIDED = "again struct<record_id: string, url: string, date: string>"
WARC_SCHEMA = "type string, record_id string, date string, url string, refers_to string, payload_digest string, page_id long, head binary, payload binary"


def header_url(url: str | None) -> str:
    """A URL without white space or control characters."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "about:blank"


def _arc_texts(version: int, date: str):
    def run(frames):
        body = f"{version} 0 rampwise\n{ARC_FIELDS[version]}\n".encode()
        yield pd.DataFrame({"value": [f"filedesc://pages-v{version}.arc 0.0.0.0 {date} text/plain ".encode() + (b"" if version == 1 else b"200 - - 0 pages.arc ") + str(len(body)).encode() + b"\n" + body]})
        for pdf in frames:
            out = []
            for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n".encode()
                head += b"" if pd.isna(page) else f"{ID_HEADER}: {int(page)}\r\n".encode()
                doc = head + b"\r\n" + html
                extra = "" if version == 1 else f"200 {hashlib.md5(html).hexdigest()} - 0 pages.arc "
                out.append(f"{header_url(url)} 0.0.0.0 {date} text/html {extra}{len(doc)}\n".encode() + doc)
            yield pd.DataFrame({"value": out})

    return run


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """ARC files of the given version, one for each partition of ``pages``."""
    own = pages.select(column(id_col).cast("long").alias("page_id"), column(url_col).alias("url"), F.coalesce(column(payload_col).cast("binary"), F.lit(b"")).alias("html"))
    own.mapInPandas(_arc_texts(version, date), "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,arc,warc}").load(path).select("path", "content")


class Unpacked(io.RawIOBase):
    """A stream over compressed bytes of one or more gzip members."""

    def __init__(self, data: bytes):
        self.data, self.out, self.z = memoryview(data), b"", zlib.decompressobj(31)
        self.at = 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out:
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return 0
            part = self.data[self.at : self.at + (1 << 16)]
            self.at += len(part)
            self.out = self.z.decompress(part)
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


def page_id_of(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == ID_HEADER.lower().encode() and value.strip().lstrip(b"-").isdigit():
            return int(value)
    return None


def parse_arc(name: str, data: bytes):
    """The records of one ARC file, as rows of ``ARC_SCHEMA``."""
    raw = Unpacked(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    stream, offset, version, lost = io.BufferedReader(raw, 1 << 20), 0, None, False
    while line := stream.readline():
        if not line.strip():
            offset += len(line)
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        first = text.startswith("filedesc:")
        found = next((m for v in ((2, 1) if first else (version,) if version else ()) if (m := HEADERS[v].fullmatch(text))), None)
        if found and lost and not SCHEME.match(text):
            found = None
        declared = found[5] if found else None if lost else (re.search(r" (\d+)$", text) or [None, None])[1]
        if declared is None:
            lost, offset = True, offset + len(line)
            continue
        lost, body = False, stream.read(int(declared))
        if first and found:
            said = body.split(b" ", 1)[0]
            version = int(said) if said.isdigit() and int(said) in ARC_FIELDS else 1 if found.re is HEADERS[1] else 2
        kind = "resource" if not found else "warcinfo" if first else "response" if body.startswith(b"HTTP/") else "resource"
        head, _, payload = body.partition(b"\r\n\r\n") if kind == "response" else (b"", b"", body)
        url, ip, d, content = (found[1], found[2], found[3], found[4] or "application/octet-stream") if found else (f"about:{quote(name, safe='')}#{offset}", "0.0.0.0", "19700101", "application/octet-stream")
        d, sha1 = d[:14].ljust(8, "0").ljust(14, "0"), hashlib.sha1(payload)
        iso = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        yield (kind, name, offset, version, url if kind == "warcinfo" or " " not in url else header_url(url), ip, iso, content, len(body) < int(declared), page_id_of(head), str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}")), sha1.hexdigest(), base64.b32encode(sha1.digest()).decode(), len(payload), head, payload)
        offset += len(line) + len(body)


def batched(rows, columns: list[str], most: int = 8 << 20):
    """Frames of rows whose last fields hold about ``most`` bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, bytes))
        if n >= most:
            yield pd.DataFrame(held, columns=columns).astype({"page_id": "Int64"})
            held, n = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns).astype({"page_id": "Int64"})


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def arc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all ARC files below ``path``, with their synthesised WARC identifiers, timestamps and digests; without ``payloads``, all but their content."""
    schema = ARC_SCHEMA if payloads else LIGHT_SCHEMA

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = parse_arc(name, content)
                yield from batched(rows if payloads else (r[:-2] for r in rows), _names(schema))

    return _files(spark, path).mapInPandas(run, schema)


def _decided(frames):
    """The records of files that come with what is decided about them, by offset."""
    for pdf in frames:
        for name, content, offsets, places in zip(pdf["path"], pdf["content"], pdf["offsets"], pdf["places"], strict=True):
            known = dict(zip(offsets.tolist(), places, strict=True)) if offsets is not None else {}
            yield from batched(((*r, known.get(r[2])) for r in parse_arc(name, content)), [*_names(ARC_SCHEMA), "again"])


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = REVISIT_FROM) -> None:
    """WARC files in ``warc_path`` from all ARC files below ``arc_path``. What is shuffled are digests, places and (unless the lists of revisits are small) compressed files."""
    light = written(arc_records(spark, arc_path, payloads=False).filter((F.col("type") == "response") & (F.col("bytes") >= least)).select("file", "offset", "sha1", "bytes", "page_id", "record_id", "url", "date"), "warc-places")
    group = light.groupBy("sha1", "bytes").agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(group.filter("n > 1").select("sha1", "bytes", "first"), "warc-groups")
    again = light.join(first, ["sha1", "bytes"]).filter("first.record_id <> record_id")
    lists = again.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", F.struct("first.record_id", "first.url", "first.date").alias("place")))).alias("r"))
    lists = written(lists.select(F.col("file").alias("path"), F.col("r.offset").alias("offsets"), F.col("r.place").alias("places")), "warc-lists")
    got = _files(spark, arc_path).join(lists, "path", "left").select("path", "content", "offsets", "places").mapInPandas(_decided, f"{ARC_SCHEMA}, {DECIDED}")
    revisit = F.col("again").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(revisit, F.concat(F.col("head"), F.lit(b"\r\n\r\n"))).when(F.col("type") != "response", F.col("payload")).otherwise(F.concat(F.col("head"), F.lit(b"\r\n\r\n"), F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("type"))), line("WARC-Record-ID", urn(F.col("record_id"))), line("WARC-Date", F.col("date")),
        F.when(F.col("type") == "warcinfo", line("WARC-Filename", F.element_at(F.split("file", "/"), -1))).otherwise(F.concat(line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")))),
        F.when(F.col("truncated"), line("WARC-Truncated", F.lit("unspecified"))).otherwise(F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1_base32"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("again.record_id"))), line("WARC-Refers-To-Target-URI", F.col("again.url")), line("WARC-Refers-To-Date", F.col("again.date")))).otherwise(F.lit("")),
        line("Content-Type", F.when(F.col("type") == "response", F.lit("application/http; msgtype=response")).otherwise(F.col("content_type"))), line("Content-Length", F.length(block).cast("string")), F.lit("\r\n"),
    )
    got.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)


def parse_warc(data: bytes):
    """The records of one WARC file."""
    stream = io.BufferedReader(Unpacked(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        own = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            own[name.strip().lower()] = value.strip()
        block = stream.read(int(own["content-length"]))
        head, _, payload = block.partition(b"\r\n\r\n") if own["warc-type"] in ("response", "revisit") else (b"", b"", block)
        bare = lambda x: x[len("<urn:uuid:") : -1] if x else None
        yield own["warc-type"], bare(own["warc-record-id"]), own["warc-date"], own.get("warc-target-uri"), bare(own.get("warc-refers-to")), own.get("warc-payload-digest"), page_id_of(head), head, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below ``path``; a revisit's payload is empty, its ``refers_to`` is the response's record id."""

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                yield from batched(parse_warc(content), _names(WARC_SCHEMA))

    return _files(spark, path).mapInPandas(run, WARC_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit; what a revisit refers to is looked up by its record id.

    Only revisits are joined: responses refer to nothing.
    """
    records = records.filter(F.col("type").isin("response", "revisit"))
    light = written(records.select("type", "record_id", "refers_to", "page_id", F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest")), "warc-records")
    there = light.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("there"), F.col("bytes").alias("its_bytes"), F.col("digest").alias("its_digest"))
    again = light.filter("type = 'revisit'").join(there, "refers_to", "left").select("page_id", F.col("its_bytes").alias("bytes"), F.col("its_digest").alias("digest"), "type", "there")
    got = light.filter("type = 'response'").select("page_id", "bytes", "digest", "type", F.lit(None).cast("long").alias("there")).union(again)
    return got.toDF("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Pages to ARC (half of them in each version), to WARC, and back: see ``resolved``."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "warc")
    for version in ARC_FIELDS:
        write_arc(pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(2)) == version - 1), f"{path}/arc/v{version}", version, **options)
    convert(spark, f"{path}/arc", f"{path}/warc")
    return resolved(read_warc(spark, f"{path}/warc"))
