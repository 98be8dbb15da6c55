"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response record becomes two records that refer to it by its identifier: ``metadata`` (application/warc-fields:
title, language, outlinks, the source's HTTP header lines and its digests) and ``conversion`` (text/plain: the
document's text without markup). Both keep the target URI and date, carry the digest of their own block, name the other
as concurrent, and carry the source's digests and HTTP header lines (WARC-Source-... fields of the conversion).
Identifiers are derived from the response's identifier, so that a task that runs again writes the same records.

A body is read as it was sent: chunks are joined, codings undone from the last to the first (gzip with all its members,
deflate), and the charset is that of the Content-Type
header, else of a meta element at its beginning, else UTF-8. Digests are of the bytes as they stand in the archive.

Defined cases: what is no record (no blank line after its head, a length that is no number or goes beyond the file,
a damaged gzip member) becomes a record of kind malformed with the bytes up to the next record, from where reading goes
on, and gives one row of that kind; a damaged chunk, coding or unknown charset leaves what can be read, with replacement
characters; another coding leaves an empty conversion, and the metadata names it; a length of 19 digits or more is no number; a response without an HTTP head has no header lines and its whole block is payload; null blocks and HTML
are empty; null URIs are written as an empty value; every response gives two records, repeated or not; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.llm.common import OWN, map_batches, table

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def one_line(x: str) -> str:
    """A header value: line breaks would end it."""
    return re.sub(r"[\r\n\x00]+", " ", x)


@dataclass
class Record:
    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def get(self, name: str, default: str = "") -> str:
        return next((v for k, v in self.headers if k.lower() == name.lower()), default)

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in self.headers)
        return b"WARC/1.1\r\n" + head.encode() + CRLF + self.block + CRLF + CRLF


def _unpacked(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they could be read) of gzip members; bytes that are no gzip as they are."""
    while data:
        if data[:2] != b"\x1f\x8b":
            start = data.find(b"\x1f\x8b")
            yield (data if start < 0 else data[:start]), True
            data = b"" if start < 0 else data[start:]
            continue
        reader = zlib.decompressobj(31)
        try:
            out = reader.decompress(data) + reader.flush()
        except zlib.error:
            reader, out = None, b""
        if reader is None or not reader.eof:
            # go on with the next member
            start = data.find(b"\x1f\x8b\x08", 2)
            yield (out or data[:start] if start > 0 else out or data), False
            data = data[start:] if start > 0 else b""
        else:
            yield out, True
            data = reader.unused_data


def malformed(data: bytes) -> Record:
    return Record([("WARC-Type", "malformed"), ("Content-Length", str(len(data)))], data)


def parse(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or of gzip members, and what is none as malformed ones."""
    if data[:2] == b"\x1f\x8b":
        whole = b""
        for part, good in _unpacked(data):
            if good:
                whole += part
            else:
                yield from _records(whole)
                yield malformed(part)
                whole = b""
        data = whole
    yield from _records(data)


def _records(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        start = data.find(b"WARC/", at)
        if start < 0:
            start = len(data)
        if data[at:start].strip(b"\r\n"):
            yield malformed(data[at:start])
        if start == len(data):
            break
        end = data.find(CRLF + CRLF, start)
        after = data.find(b"\r\nWARC/", start)
        after = len(data) if after < 0 else after + 2
        lines = data[start : end if end >= 0 else start].decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if end < 0 or end > after or not (size.isascii() and size.isdigit() and len(size) < 19) or end + 4 + int(size) > len(data):
            yield malformed(data[start:after])
            at = after
            continue
        at = end + 4 + int(size)
        yield Record(headers, data[end + 4 : at])


def response(key: str, uri: str, payload: bytes, date: str = DATE) -> Record:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    return Record(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", record_id(key)),
            ("WARC-Target-URI", uri),
            ("WARC-Date", date),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", digest(payload)),
            ("WARC-Block-Digest", digest(block)),
            ("Content-Length", str(len(block))),
        ],
        block,
    )


_hidden = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|head)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_breaks = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|nav|footer|header|aside|blockquote|pre|form|dd|dt|dl|main|figure|body|html)\b|br\b|hr\b)[^>]*>", re.I)
_tags = re.compile(r"<[/!?a-zA-Z][^>]*>?")
_title = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_lang = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_links = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def plain_text(page: str) -> str:
    """Lines of text: markup, scripts and styles go, blocks end a line, white space is collapsed."""
    text = html_lib.unescape(_tags.sub("", _breaks.sub("\n", _hidden.sub("", page))))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


_charset = re.compile(rb"""<meta\b[^>]{0,200}?charset\s*=\s*["']?([A-Za-z0-9_:.-]+)""", re.I)


def joined_chunks(body: bytes) -> bytes:
    """The body of a chunked message, as far as its chunks are whole."""
    out, at = [], 0
    while (end := body.find(CRLF, at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size) or int(size, 16) == 0:
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


#: How zlib reads each coding; deflate comes with and without its frame.
CODINGS = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}


def inflated(payload: bytes, bits: tuple[int, ...]) -> bytes:
    """The payload without its compression, all members of it; what isn't compressed at all stays."""
    for kind in bits:
        out, rest = [], payload
        try:
            while rest.strip(b"\0"):
                reader = zlib.decompressobj(kind)
                out.append(reader.decompress(rest))
                rest = reader.unused_data if kind == 31 else b""
        except zlib.error:
            if not out:
                continue
        return b"".join(out)
    return payload


def decoded(head: bytes, payload: bytes) -> tuple[str, str]:
    """A message's text: chunks joined, codings undone from the last to the first, by its charset; and the coding that can't be undone, then without text."""
    lines = [x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]]
    get = lambda name: ",".join(v.strip().lower() for k, _, v in lines if k.strip().lower() == name)
    if "chunked" in get("transfer-encoding"):
        payload = joined_chunks(payload) or payload
    for coding in reversed([x.strip() for x in get("content-encoding").split(",")]):
        if coding in CODINGS:
            payload = inflated(payload, CODINGS[coding])
        elif coding not in ("", "identity"):
            return "", coding
    kind = get("content-type")
    named = re.search(r"charset\s*=\s*[\"']?([a-z0-9_:.-]+)", kind)
    meta = None if named else _charset.search(payload, 0, 2048)
    charset = named[1] if named else meta[1].decode("ascii") if meta else "utf-8"
    try:
        return payload.decode(charset, "replace"), ""
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace"), ""


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata and conversion records of a response."""
    head, gap, payload = source.block.partition(CRLF + CRLF)
    if not source.block.startswith(b"HTTP/") or not gap:
        head, payload = b"", source.block
    page, undecoded = decoded(head, payload)
    of = source.get("WARC-Record-ID")
    ids = {kind: record_id(f"{of} {kind}") for kind in ("metadata", "conversion")}
    fields = [("undecodedContentEncoding", undecoded)] if undecoded else []
    if m := _title.search(page):
        fields.append(("title", " ".join(html_lib.unescape(m[1]).split())))
    if m := _lang.search(page):
        fields.append(("languages", m[1]))
    digests = [("PayloadDigest", source.get("WARC-Payload-Digest") or digest(payload)), ("BlockDigest", source.get("WARC-Block-Digest") or digest(source.block))]
    lines = [("Header", x) for x in head.decode("utf-8", "replace").split("\r\n") if x]
    fields += [(f"source{k}", v) for k, v in digests + lines]
    fields += [("outlink", html_lib.unescape(a or b or c)) for a, b, c in _links.findall(page)]
    blocks = {"metadata": "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode(), "conversion": plain_text(page).encode("utf-8", "replace")}
    out = []
    for kind, other, content in (("metadata", "conversion", "application/warc-fields"), ("conversion", "metadata", "text/plain; charset=utf-8")):
        block = blocks[kind]
        headers = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", ids[kind]),
            ("WARC-Refers-To", of),
            ("WARC-Concurrent-To", ids[other]),
            ("WARC-Target-URI", source.get("WARC-Target-URI")),
            ("WARC-Date", source.get("WARC-Date")),
            ("Content-Type", content),
            ("WARC-Block-Digest", digest(block)),
            *[(f"WARC-Source-{k.replace('Digest', '-Digest')}", v) for k, v in (digests + lines if kind == "conversion" else [])],
            ("Content-Length", str(len(block))),
        ]
        out.append(Record(headers, block))
    return out[0], out[1]


def responses(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep of pages (page_id, url, html) with record: each page as the bytes of a response record."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(keep)
        key, url, page = (batch.column(n + i).to_pylist() for i in range(3))
        out = [response(f"{k} {u or ''}", u or "", (p or "").encode("utf-8", "replace")).to_bytes() for k, u, p in zip(key, url, page)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(out, type=pa.binary())], names=[*keep, OWN + "record"])

    columns = [pages[k] for k in keep] + [F.col("page_id").cast("string").alias(OWN + "k"), F.col("url").alias(OWN + "u"), F.col("html").alias(OWN + "h")]
    return map_batches(pages.select(*columns), one, f"{_kinds(pages, keep)}{OWN}record binary")


def _kinds(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)


OUT = "kind string, record_id string, refers_to string, target_uri string, block_digest string, source_payload_digest string, content_length long, record binary"


def derivatives(source: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows, of OUT, for each response record in column _ts_record, one for what is malformed; record holds the bytes to write."""
    names = [*keep, *(x.split()[0] for x in OUT.split(", "))]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(keep)
        rows, take = [], []
        for i, data in enumerate(batch.column(n).to_pylist()):
            for found in parse(data or b""):
                if (kind := found.get("WARC-Type")) == "malformed":
                    rows.append((kind, None, None, None, None, None, len(found.block), found.block))
                    take.append(i)
                if kind != "response":
                    continue
                payload = found.get("WARC-Payload-Digest")
                for x in derive(found):
                    rows.append((x.get("WARC-Type"), x.get("WARC-Record-ID"), x.get("WARC-Refers-To"), x.get("WARC-Target-URI"), x.get("WARC-Block-Digest"), payload, len(x.block), x.to_bytes()))
                    take.append(i)
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        columns = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(take, type=pa.int64())) for i in range(n)), *columns], names=names)

    return map_batches(source.select(*keep, OWN + "record"), one, _kinds(source, keep) + OUT)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: file, number, kind, record_id, refers_to, target_uri, block_digest, block. A file is read by one task."""
    schema = "file string, number long, kind string, record_id string, refers_to string, target_uri string, block_digest string, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [
                    (name, i, r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"), r.get("WARC-Block-Digest"), r.block)
                    for i, r in enumerate(parse(data))
                ]
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derivatives(responses(table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")
