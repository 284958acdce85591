"""Archive-metadata files (gzip of records, each a JSON envelope of one page) as page and link tables.

Spark's text source does the framing: the record marker is the line separator,
so that a task streams through its gzip file and holds one record at a time.
Headers, byte lengths and UTF-8 are checked in the JVM; Python sees only the
JSON of sound records, whose nodes have no fixed types.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native as N

MARKER = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
PAGES = ("crawl", "source_url", "source_host", "crawled_at", "status", "content_type", "title", "description", "canonical")
LINKS = ("crawl", "source_url", "source_host", "target_url", "target_host", "anchor", "crawled_at")
_PARSED = (
    "input string, input_bytes long, bad_framing int, seen int, bad_json int, bad_record int,"
    " page struct<source_url:string,source_host:string,date:string,status:string,content_type:string,title:string,description:string,canonical:string>,"
    " links array<struct<target_url:string,target_host:string,anchor:string>>"
)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")


def framed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(input, input_bytes, payload, bad_framing, seen, bad_json) of every JSON record.

    A record without a byte length, or shorter than it says, is bad framing and
    has a null payload; invalid UTF-8 is bad JSON.  Other record types are left out.
    """
    raw = spark.read.option("lineSep", MARKER).text(paths).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("input"), F.col("_metadata.file_size").alias("input_bytes"), "value")
    head = F.substring_index("value", GAP, 1)
    rows = raw.where(F.col("value") != "").withColumn("head", head).where(F.col("head").rlike(r"(?im)^content-type:[ \t]*application/json[ \t]*$"))
    rows = rows.withColumn("length", F.regexp_extract("head", r"(?im)^content-length:[ \t]*(\d+)[ \t]*$", 1).try_cast("int"))
    body = F.substring(F.col("value").cast("binary"), F.octet_length("head") + len(GAP) + 1, F.coalesce("length", F.lit(0)))
    rows = rows.withColumn("body", body).withColumn("sound", F.col("length").isNotNull() & F.contains("value", F.lit(GAP)) & (F.octet_length("body") == F.col("length")))
    text = F.col("body").cast("string")
    valid = F.is_valid_utf8(text)
    return rows.select(
        "input", "input_bytes", F.when(F.col("sound") & valid, text).alias("payload"),
        (~F.col("sound")).cast("int").alias("bad_framing"), F.col("sound").cast("int").alias("seen"), (F.col("sound") & ~valid).cast("int").alias("bad_json"),
    )


def _at(node, *path):
    for name in path:
        node = node.get(name) if isinstance(node, dict) else None
    return node


def _objects(node) -> list[dict]:
    return [x for x in node if isinstance(x, dict)] if isinstance(node, list) else []


def _plain(node) -> str | None:
    """A node as text: lists joined by "; ", objects as sorted JSON, no NUL, no lone surrogates."""
    if node is None:
        return None
    if isinstance(node, list):
        node = "; ".join(map(str, node))
    elif isinstance(node, dict):
        node = json.dumps(node, ensure_ascii=False, sort_keys=True)
    return str(node).replace("\0", "").encode("utf-8", "replace").decode()


def _host(url: str | None) -> str | None:
    try:
        return urlparse(url).hostname if url else None
    except ValueError:
        return None


def _named(nodes, key: str, name: str, value: str) -> str | None:
    return next((_plain(x.get(value)) for x in _objects(nodes) if (_plain(x.get(key)) or "").lower() == name), None)


def _resolved(base: str, ref: str) -> dict | None:
    """The absolute target of a link; a target with a scheme that does not parse stays as it is, without a host."""
    try:
        url = urljoin(base, ref)
        return {"target_url": url, "target_host": urlparse(url).hostname}
    except ValueError:
        return {"target_url": ref, "target_host": None} if _SCHEME.match(ref) and not set("[]") & set(ref) else None


def envelope(payload: str) -> dict:
    """What one record says: counters of bad parts, the page or None, its links."""
    out = {"bad_json": 0, "bad_record": 0, "page": None, "links": []}
    try:
        node = json.loads(payload)
    except (ValueError, RecursionError):
        return out | {"bad_json": 1}
    meta, header = _at(node, "Envelope", "Payload-Metadata"), _at(node, "Envelope", "WARC-Header-Metadata")
    if not isinstance(meta, dict) or not isinstance(header, dict):
        return out | {"bad_record": 1}
    http, url = meta.get("HTTP-Response-Metadata"), _plain(header.get("WARC-Target-URI"))
    if not isinstance(http, dict) or not url:
        return out
    head = _at(http, "HTML-Metadata", "Head")
    for link in _objects(_at(http, "HTML-Metadata", "Links")):
        ref = _plain(link.get("url")) if _plain(link.get("path")) == "A@/href" else None
        if not ref:
            continue
        target = _resolved(url, ref)
        if target is None:
            out["bad_record"] += 1
        else:
            out["links"].append(target | {"anchor": _plain(link.get("text"))})
    out["page"] = {
        "source_url": url, "source_host": _host(url), "date": _plain(header.get("WARC-Date")),
        "status": _plain(_at(http, "Response-Message", "Status")), "content_type": _plain(_at(http, "Headers", "Content-Type")), "title": _plain(_at(head, "Title")),
        "description": _named(_at(head, "Metas"), "name", "description", "content"), "canonical": _named(_at(head, "Link"), "rel", "canonical", "url"),
    }
    return out


def _envelopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):  # links outgrow their records; small frames bound what is held
            part = batch.iloc[at : at + 256]
            found = [envelope(p) if isinstance(p, str) else {"bad_json": 0, "bad_record": 0, "page": None, "links": []} for p in part["payload"]]
            yield pd.DataFrame({
                "input": part["input"].array, "input_bytes": part["input_bytes"].array, "bad_framing": part["bad_framing"].array, "seen": part["seen"].array,
                "bad_json": [int(b) + x["bad_json"] for b, x in zip(part["bad_json"], found, strict=True)], "bad_record": [x["bad_record"] for x in found],
                "page": [x["page"] for x in found], "links": [x["links"] for x in found],
            })


def parsed(spark: SparkSession, paths: list[str] | str, crawl: str) -> DataFrame:
    """One row per record: its input, counters, page (null where it is no page) and links; narrow, nothing is shuffled."""
    return from_framed(framed(spark, paths), crawl)


def from_framed(rows: DataFrame, crawl: str) -> DataFrame:
    """`parsed` for records that are framed already."""
    return rows.mapInPandas(_envelopes, _PARSED).withColumn("crawl", F.lit(crawl))


def _shared():
    return F.col("page.source_url").alias("source_url"), F.col("page.source_host").alias("source_host"), N.wall_clock("page.date").alias("crawled_at")


def pages(rows: DataFrame) -> DataFrame:
    """The page table; display texts are repaired, addresses are not."""
    shown = [N.repair_mojibake(f"page.{x}").alias(x) for x in ("status", "content_type", "title", "description")]
    return rows.where("page is not null").select("crawl", *_shared(), *shown, F.col("page.canonical").alias("canonical")).select(*PAGES)


def links(rows: DataFrame) -> DataFrame:
    """The link table, a multigraph: repeated links stay."""
    each = rows.where("page is not null").select("crawl", *_shared(), F.explode("links").alias("l"))
    return each.select("crawl", "source_url", "source_host", "l.target_url", "l.target_host", N.repair_mojibake("l.anchor").alias("anchor"), "crawled_at")


def metrics(rows: DataFrame) -> DataFrame:
    """Counters of each input, combined before the shuffle."""
    changed = lambda x: (~N.repair_mojibake(x).eqNullSafe(x)).cast("long")
    repairs = sum((changed(F.col(f"page.{c}")) for c in ("status", "content_type", "title", "description")), F.lit(0)) + F.aggregate("links", F.lit(0).cast("long"), lambda n, l: n + changed(l["anchor"]))
    total = lambda c, name: F.sum(c).alias(name)
    return rows.groupBy("input").agg(
        F.max("input_bytes").alias("input_bytes"), F.count("page").alias("pages_emitted"), F.coalesce(F.sum(F.when(F.col("page").isNotNull(), F.size("links"))), F.lit(0)).alias("links_emitted"),
        total("seen", "records_seen"), total("bad_record", "malformed_records"), total("bad_json", "malformed_json"), total("bad_framing", "malformed_warc"),
        F.coalesce(F.sum(F.when(F.col("page").isNotNull(), repairs)), F.lit(0)).alias("encoding_repairs"),
    )


def ingest(spark: SparkSession, paths: list[str] | str, out: str, crawl: str, resume: bool = True) -> DataFrame:
    """Write `pages`, `links` and `metrics` below `out`, one partition per input, and return all metrics.

    Every input is parsed once into a staging table that both outputs read with
    pruned columns.  Partitions are overwritten, so a repeated run changes
    nothing; metrics come last, and an input that has them is done.  Only the
    list of files is on the driver.
    """
    if not isinstance(paths, str) and len(set(paths)) < len(paths):
        raise ValueError("an input is listed twice")
    files = sorted({re.sub("^file:/+", "file:/", f) for f in spark.read.text(paths).inputFiles()})
    if resume and _exists(spark, f"{out}/metrics"):
        done = {r.input for r in spark.read.parquet(f"{out}/metrics").select("input").toLocalIterator()}
        files = [f for f in files if f not in done]
    if files:
        key = N.input_key("input").alias("input_key")
        parsed(spark, [unquote(f) for f in files], crawl).select("*", key).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/_staging")
        rows = spark.read.parquet(f"{out}/_staging")
        listed = spark.createDataFrame([(f,) for f in files], "input string")
        counted = listed.join(metrics(rows), "input", "left").fillna(0).withColumn("input_key", N.input_key("input"))
        for name, table in (("pages", pages(_keyed(rows))), ("links", links(_keyed(rows)))):
            _write(table.withColumn("input_key", F.col("crawl")["key"]).withColumn("crawl", F.col("crawl")["name"]), f"{out}/{name}")
        _write(counted, f"{out}/metrics")
        _drop(spark, f"{out}/_staging")
    return spark.read.parquet(f"{out}/metrics")


def report(metrics: DataFrame, inputs: DataFrame) -> DataFrame:
    """Metrics in the order of a list of inputs (idx, input); an input without metrics has nulls."""
    return inputs.join(metrics, "input", "left").orderBy("idx")


def _keyed(rows: DataFrame) -> DataFrame:
    """Carries the input's key through the projections beside the crawl's name."""
    return rows.withColumn("crawl", F.struct(F.col("crawl").alias("name"), F.col("input_key").alias("key")))


def _write(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("input_key").parquet(path)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)
