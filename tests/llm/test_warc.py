import base64
import gzip
import hashlib
import uuid
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenscope.llm import warc
from tokenscope.llm.common import prepare

PAGE = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><style>p{x}</style></head><body><script>var t="</p>";</script>
<nav><a href="/x?a=1&amp;b=2">X</a></nav><p>One  <b>two</b></p><!-- no --><p>caf&eacute; &lt;3<br>last</body></html>"""


def test_derive_links_and_digests():
    source = warc.response("k", "http://a/", PAGE.encode())
    meta, text = warc.derive(source)
    assert text.block.decode() == "X\nOne two\ncafé <3\nlast"
    assert meta.get("WARC-Refers-To") == text.get("WARC-Refers-To") == source.get("WARC-Record-ID")
    assert meta.get("WARC-Concurrent-To") == text.get("WARC-Record-ID")
    assert text.get("WARC-Block-Digest") == warc.digest(text.block)
    lines = meta.block.decode().split("\r\n")
    assert "title: A & B" in lines and "languages: en" in lines and "outlink: /x?a=1&b=2" in lines
    assert f"sourcePayloadDigest: {warc.digest(PAGE.encode())}" in lines and "sourceHeader: HTTP/1.1 200 OK" in lines


def test_round_trip_through_files(spark, tmp_path):
    prepare(spark)
    records = [warc.response(str(i), f"http://a/{i}", (PAGE * i).encode()) for i in range(4)]
    both = [y for x in records for y in (x, *warc.derive(x))]
    (tmp_path / "a.warc").write_bytes(b"".join(x.to_bytes() for x in both))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x.to_bytes()) for x in both))
    got = warc.read_warc(spark, str(tmp_path)).orderBy("file", "number").collect()
    assert [x.block for x in got] == [bytearray(x.block) for x in both] * 2
    assert [x.record_id for x in got] == [x.get("WARC-Record-ID") for x in both] * 2


def test_query_equals_rows_made_one_by_one(spark):
    prepare(spark)
    pages = [(1, "http://a/", PAGE), (2, None, None), (3, "http://b/\r\nX: y", ""), (1, "http://a/", PAGE), (None, "u", "<p>x"), (5, "u", "x" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"kind": F.lit(1), "record": F.lit(2)})
    want = []
    for key, url, page in pages:
        for x in warc.derive(next(warc.parse(warc.response(f"{key} {url or ''}", url or "", (page or "").encode()).to_bytes()))):
            want.append((key, x.get("WARC-Type"), x.get("WARC-Record-ID"), x.get("WARC-Refers-To"), hashlib.sha256(x.to_bytes()).hexdigest()))
    out = warc.derivatives(warc.responses(df, ["page_id"]), ["page_id"]).withColumn("sha", F.sha2("record", 256))
    got = [(x.page_id, x.kind, x.record_id, x.refers_to, x.sha) for x in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.derivatives(warc.responses(df.limit(0), ["page_id"]), ["page_id"]).count() == 0


def message(body, *lines):
    return "\r\n".join(["HTTP/1.1 200 OK", *lines, "", ""]).encode() + body


def made(block, **headers):
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2024-05-06T07:08:09Z", **headers}
    return warc.Record([*fields.items(), ("Content-Length", str(len(block)))], block)


def test_conversion_record_by_hand():
    """Every line of a conversion record, written out."""
    block = message(b"<p>one<p>two", "Content-Type: text/html")
    _, text = warc.derive(made(block))
    payload_digest = "sha1:" + base64.b32encode(hashlib.sha1(b"<p>one<p>two").digest()).decode()
    block_digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    own = "sha1:" + base64.b32encode(hashlib.sha1(b"one\ntwo").digest()).decode()
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    meta_id, text_id = (f"<urn:uuid:{uuid.uuid5(space, '<urn:x:1> ' + kind)}>" for kind in ("metadata", "conversion"))
    want = [
        "WARC/1.1", "WARC-Type: conversion", f"WARC-Record-ID: {text_id}", "WARC-Refers-To: <urn:x:1>", f"WARC-Concurrent-To: {meta_id}", "WARC-Target-URI: http://a/", "WARC-Date: 2024-05-06T07:08:09Z",
        "Content-Type: text/plain; charset=utf-8", f"WARC-Block-Digest: {own}", f"WARC-Source-Payload-Digest: {payload_digest}", f"WARC-Source-Block-Digest: {block_digest}",
        "WARC-Source-Header: HTTP/1.1 200 OK", "WARC-Source-Header: Content-Type: text/html", "Content-Length: 7", "", "one\ntwo", "", "",
    ]
    assert text.to_bytes().decode() == "\r\n".join(want)


@pytest.mark.parametrize(
    "block",
    [
        message("<p>café".encode("iso-8859-1"), "Content-Type: text/html; charset=ISO-8859-1"),
        message('<meta charset="windows-1252"><p>café'.encode("cp1252")),
        message(gzip.compress("<p>café".encode()), "Content-Encoding: gzip"),
        message(zlib.compress("<p>café".encode()), "content-encoding: deflate", "Content-Type: text/html; charset=no-such"),
        message(b"4\r\n<p>c\r\n3;x=y\r\naf\xc3\r\n1\r\n\xa9\r\n0\r\n\r\n", "Transfer-Encoding: chunked"),
        "<p>café".encode(),
        message(gzip.compress(b"<p>ca") + gzip.compress("fé".encode()), "Content-Encoding: gzip"),
        message(gzip.compress("<p>café".encode()), "Content-Encoding: gzip, identity"),
        message(gzip.compress(zlib.compress("<p>café".encode())), "Content-Encoding: deflate", "Content-Encoding: gzip"),
    ],
)
def test_bodies_as_they_were_sent(block):
    assert warc.derive(made(block))[1].block.decode() == "café"


def test_a_coding_that_cannot_be_undone_gives_no_text():
    metadata, conversion = warc.derive(made(message(b"\x8b\x02\x80caf\x03", "Content-Encoding: br")))
    assert conversion.block == b"" and b"undecodedContentEncoding: br\r\n" in metadata.block


@pytest.mark.parametrize("digits", ["9" * 5000, "9" * 19, "-1", "1_0", "\u0661"])
def test_lengths_that_are_none(digits):
    good = made(message(b"<p>x")).to_bytes()
    at = good.index(b"Content-Length: ")
    bad = good[:at] + f"Content-Length: {digits}".encode() + good[good.index(b"\r\n", at) :]
    assert [r.get("WARC-Type") for r in warc.parse(bad + good)] == ["malformed", "response"]


def test_damaged_archives_go_on(spark):
    prepare(spark)
    good = [made(message(f"<p>{i}".encode())).to_bytes() for i in range(4)]
    bad_length = good[0].replace(b"Content-Length: ", b"Content-Length: x", 1)
    cut = good[1][:40]
    long = good[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    data = good[0] + bad_length + good[1] + b"junk" + cut + b"\r\n" + good[2] + good[3] + long
    kinds = [r.get("WARC-Type") for r in warc.parse(data)]
    assert kinds.count("response") == 4 and kinds.count("malformed") == 4
    packed = gzip.compress(good[0]) + gzip.compress(good[1])[:-20] + gzip.compress(good[2])
    kinds = [r.get("WARC-Type") for r in warc.parse(packed)]
    assert kinds == ["response", "malformed", "response"]
    df = spark.createDataFrame([(1, data), (2, packed), (3, None), (4, b"nothing")], "page_id long, _ts_record binary")
    got = Counter((x.page_id, x.kind) for x in warc.derivatives(df, ["page_id"]).collect())
    assert got == {(1, "metadata"): 4, (1, "conversion"): 4, (1, "malformed"): 4, (2, "metadata"): 2, (2, "conversion"): 2, (2, "malformed"): 1, (4, "malformed"): 1}
