"""Index lines and response records."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import index

NAME = "crawl-data/C-1/segments/s.1/warc/a.warc.gz"


def line(**change):
    return json.dumps({"url": "https://A.com/x#f", "timestamp": "20260710083632", "status": "200", "mime": "text/html; charset=x", "filename": NAME, "offset": "5", "length": "9"} | change)


def test_index_lines(spark):
    cases = [line(), line(url="https://a.com/y", offset="6") + "\r", "", line(url="https://a.com/x", offset="7"), line(url="https://other.com/", offset="8"), line(url="https://a.com/z")]
    bad = {"{no": "malformed record", "[1]": "malformed record", line(status=200): "malformed record", line(mime="text/plain"): "malformed record", line(timestamp="20260230000000"): "timestamp", line(url="https://u@a.com/"): "unsafe url", line(url="https://a.com:8443/"): "unsafe url", line(url="https://a.com/%0a"): "unsafe url", line(filename="x/" + NAME): "file name", line(offset="05"): "offset", line(length="0"): "length", line(length="99999999"): "range"}
    lines = spark.createDataFrame(list(enumerate([*cases, *bad])), "line_no long, value string")
    parsed = index.index_lines(lines, "C-1")
    got = [r.fault for r in parsed.orderBy("line_no").collect()]
    assert got == [None] * 5 + list(bad.values())
    found = index.index_records(parsed, "a.com").orderBy("line_no").collect()
    assert [r.normalized_url for r in found] == ["https://a.com/x", "https://a.com/y"]  # a later capture and a repeated range go
    assert str(found[0].captured_at) == "2026-07-10 08:36:32"
    assert index.faults(parsed).agg(F.sum("n")).first()[0] == len(bad)


def body(html=b"<p>h\xc3\xa9</p>", http=b"", status=b"200 OK", kind=b"response", extra=b"\r\n\r\n", cut=0):
    inner = b"HTTP/1.1 " + status + b"\r\nContent-Type: text/html\r\n" + http + b"\r\n" + html
    head = b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Type: application/http; msgtype=response\r\nWARC-Target-URI: https://A.com/x\r\nWARC-Date: 2026-07-10T08:36:32Z\r\nContent-Length: "
    return head + str(len(inner) + cut).encode() + b"\r\n\r\n" + inner + extra


def test_responses(spark):
    cases = {
        "ok": (body(), None), "cut": (body(cut=99), "truncated"), "more": (body(extra=b"\r\nx"), "trailing data"), "404": (body(status=b"404 Gone"), "malformed block"), "kind": (body(kind=b"request"), "record type"),
        "zip": (body(http=b"Content-Encoding: gzip\r\n"), "encoding"), "short": (body(http=b"Content-Length: 3\r\n"), "html length"), "twice": (body(http=b"Content-Type: text/xml\r\n"), "conflicting header"), "cookies": (body(http=b"Set-Cookie: a\r\nSet-Cookie: b\r\n"), None), "empty": (b"", "malformed block"),
    }
    table = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()] + [("null", None)], "path string, content binary")
    got = {r.key: r for r in index.responses(table).collect()}
    assert {k: r.fault for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert got["ok"].html == "<p>hé</p>" and got["ok"].target_url == "https://a.com/x"


@pytest.mark.parametrize("url,want", [("HTTP://X.com", "http://x.com/"), ("http://x.com:80?q", "http://x.com/?q"), ("ftp://x.com/", None), ("http://x.com/\n", None)])
def test_archive_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(index.archive_url(F.col("u"))).first()[0] == want
