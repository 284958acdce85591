"""Archive index lines and the responses that they point to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Limits of an index line, a compressed range, a URL and a block of headers.
LINE_BYTES, RANGE_BYTES, URL_CHARS, HEADER_BYTES, HEADER_FIELDS = 16_384, 1_048_576, 2_048, 32_768, 100
SAFE_INTEGER = 2**53 - 1
_URL = r"^(?i)(https?)://([^/?#@:\s\\]+)(:\d*)?([/?][^#]*)?(#.*)?$"
_FIELDS = ("url", "timestamp", "status", "mime", "filename", "offset", "length")


def archive_url(url: Column) -> Column:
    """A safe http(s) URL with lower-case host, a path and no fragment; null for control characters, users, ports other than the scheme's own and very long URLs."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    scheme, host, port, path = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    own = F.when(scheme == "http", ":80").otherwise(":443")
    control = url.rlike(r"[\x00-\x1f\x7f]|(?i)%(0[0-9a-f]|1[0-9a-f]|7f)")
    safe = url.rlike(_URL) & (port.isin("", ":") | (port == own)) & ~control & (F.length(url) <= URL_CHARS)
    tail = F.when(path == "", "/").when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.when(safe, F.concat(scheme, F.lit("://"), host, tail))


def captured(stamp: Column) -> Column:
    """Fourteen digits as a timestamp; null unless they name a real second."""
    at = F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))
    return F.when(stamp.rlike(r"^\d{14}$") & (F.date_format(at, "yyyyMMddHHmmss") == stamp), at)


def _count(text: Column, least: int) -> Column:
    n = F.when(text.rlike(r"^(0|[1-9]\d*)$"), text.try_cast("bigint"))
    return F.when(n.between(least, SAFE_INTEGER), n)


def index_lines(lines: DataFrame, collection: str) -> DataFrame:
    """`lines` (line_no, value) with parsed columns and `fault`: null for a sound line, else what is wrong first. Blank lines go."""
    rows = lines.select("line_no", F.regexp_replace("value", r"\r$", "").alias("value")).where(F.trim(F.col("value")) != "")
    node = F.try_parse_json("value")
    field = lambda c: F.when(F.schema_of_variant(F.try_variant_get("node", f"$.{c}", "variant")) == "STRING", F.try_variant_get("node", f"$.{c}", "string"))
    rows = rows.withColumn("node", node).select("line_no", "value", F.startswith(F.ltrim("value"), F.lit("{")).alias("object"), F.col("node").isNotNull().alias("json"), *[field(c).alias(f"r_{c}") for c in _FIELDS])
    rows = rows.select(
        "line_no", "value", "object", "json", "r_status", "r_mime", F.col("r_url").alias("url"), archive_url(F.col("r_url")).alias("normalized_url"), F.col("r_timestamp").alias("timestamp"),
        captured(F.col("r_timestamp")).alias("captured_at"), F.col("r_filename").alias("filename"), _count(F.col("r_offset"), 0).alias("offset"), _count(F.col("r_length"), 1).alias("length"),
    )
    named = rf"^crawl-data/{re.escape(collection)}/segments/[A-Za-z0-9._-]+/warc/[A-Za-z0-9._-]+\.warc\.gz$"
    no = lambda x: ~F.coalesce(x, F.lit(False))
    html = F.lower(F.trim(F.substring_index("r_mime", ";", 1))) == "text/html"
    fault = (
        F.when(F.octet_length("value") > LINE_BYTES, "line too long")
        .when(no(F.col("json") & F.col("object")) | no(F.col("r_status") == "200") | no(html) | F.col("url").isNull() | F.col("timestamp").isNull(), "malformed record")
        .when(F.col("normalized_url").isNull(), "unsafe url").when(F.col("captured_at").isNull(), "timestamp")
        .when(no(F.col("filename").rlike(named) & (F.length("filename") <= 512)), "file name").when(F.col("offset").isNull(), "offset").when(F.col("length").isNull(), "length")
        .when((F.col("length") > RANGE_BYTES) | (F.col("offset") > SAFE_INTEGER - (F.col("length") - 1)), "range")
    )
    return rows.withColumn("fault", fault).select("line_no", "fault", "url", "normalized_url", "timestamp", "captured_at", "filename", "offset", "length")


def index_records(parsed: DataFrame, host: str, url: str | None = None) -> DataFrame:
    """Sound records of one host (or one URL): the first of each URL, then the first of each range, by line.

    A lookup fails whole when any of its lines has a fault, so ask `faults` first.
    """
    rows = parsed.where("fault is null").where(F.lower(F.regexp_extract("normalized_url", _URL, 2)) == host.lower())
    if url is not None:
        rows = rows.where(F.col("normalized_url") == url)
    for key in (["normalized_url"], ["filename", "offset", "length"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("line_no"))).where("_n = 1").drop("_n")
    return rows.drop("fault")


def faults(parsed: DataFrame) -> DataFrame:
    return parsed.where("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


_TOKEN = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_FRAMING = {"content-length", "content-type", "warc-type", "warc-target-uri", "warc-date", "content-encoding", "transfer-encoding"}


class Fault(ValueError):
    """A response that must not be used; its text says why."""


def _block(data: bytes, first: str) -> tuple[dict[str, str], bytes]:
    """Headers (first of each name) and body of a block whose first line matches."""
    head, gap, body = data.partition(b"\r\n\r\n")
    top, *fields = head.decode("latin-1").split("\r\n")
    if not gap or len(head) > HEADER_BYTES or not re.match(first, top):
        raise Fault("malformed block")
    if len(fields) > HEADER_FIELDS:
        raise Fault("too many fields")
    headers: dict[str, str] = {}
    for line in fields:
        name, colon, value = line.partition(":")
        name, value = name.lower(), value.strip()
        if not colon or not _TOKEN.fullmatch(name) or not value:
            raise Fault("malformed block")
        if headers.setdefault(name, value) != value and name in _FRAMING:
            raise Fault("conflicting header")
    return headers, body


def _length(value: str | None) -> int:
    if value is None or not re.fullmatch(r"0|[1-9]\d*", value):
        raise Fault("length")
    return int(value)


def response(data: bytes, most: int = 2_097_152) -> dict:
    """Target, date, content type and HTML of exactly one response record; raises Fault."""
    warc, rest = _block(data, r"WARC/1\.[01]$")
    kind = [p.strip().lower() for p in warc.get("content-type", "").split(";")]
    if warc.get("warc-type", "").lower() != "response" or kind != ["application/http", "msgtype=response"]:
        raise Fault("record type")
    if "warc-target-uri" not in warc or not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3})?Z", warc.get("warc-date", "")):
        raise Fault("target or date")
    n = _length(warc.get("content-length"))
    if n > len(rest):
        raise Fault("truncated")
    if rest[n:].strip(b"\r\n"):
        raise Fault("trailing data")
    http, html = _block(rest[:n], r"HTTP/1\.[01]\s+200(\s|$)")
    if http.get("content-type", "").split(";")[0].strip().lower() != "text/html":
        raise Fault("content type")
    if http.get("content-encoding", "identity").lower() != "identity" or "transfer-encoding" in http:
        raise Fault("encoding")
    if len(html) > most or ("content-length" in http and _length(http["content-length"]) != len(html)):
        raise Fault("html length")
    return {"target_url": warc["warc-target-uri"], "date": warc["warc-date"], "content_type": http["content-type"], "html": html.decode("utf-8", "replace")}


def _responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, data in zip(batch["key"], batch["content"], strict=True):
            try:
                rows.append({"key": key, "fault": None} | response(bytes(data)))
            except Fault as e:
                rows.append({"key": key, "fault": str(e), "target_url": None, "date": None, "content_type": None, "html": None})
        yield pd.DataFrame(rows, columns=["key", "fault", "target_url", "date", "content_type", "html"])


def responses(records: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, fault, target_url, captured_at, content_type, html) of unzipped response records, such as binaryFile rows."""
    slim = records.where(F.col(content).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    out = slim.mapInPandas(_responses, "key string, fault string, target_url string, date string, content_type string, html string")
    out = out.withColumn("target_url", archive_url(F.col("target_url"))).withColumn("captured_at", F.col("date").try_cast("timestamp"))
    late = F.when(F.col("target_url").isNull(), "unsafe url").when(F.col("captured_at").isNull(), "target or date")
    return out.withColumn("fault", F.coalesce("fault", late)).select("key", "fault", "target_url", "captured_at", "content_type", "html")
