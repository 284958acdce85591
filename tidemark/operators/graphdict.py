"""Dictionary-encoded link graph and its lossless decoding.

Ids are stable keys: signed 64-bit numbers, so joins move eight bytes; N.unsigned shows them as unsigned ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native as N


def url_sources(pages: DataFrame, links: DataFrame) -> DataFrame:
    pick = lambda df, u, h: df.select(F.col(u).alias("url"), (F.col(h) if h else F.lit(None).cast("string")).alias("host"))
    every = pick(pages, "source_url", "source_host").unionByName(pick(links, "source_url", "source_host")).unionByName(pick(links, "target_url", "target_host")).unionByName(pick(pages, "canonical", None))
    return every.where("url is not null")


def host_sources(pages: DataFrame, links: DataFrame) -> DataFrame:
    every = pages.select(F.col("source_host").alias("host")).unionByName(links.select(F.col("source_host").alias("host"))).unionByName(links.select(F.col("target_host").alias("host")))
    return every.where("host is not null")


def dictionaries(pages: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    urls = url_sources(pages, links).groupBy("url").agg(F.min("host").alias("host"))
    return {
        "urls": urls.select(N.stable_key("url").alias("url_id"), "url", N.stable_key("host").alias("host_id")),
        "hosts": host_sources(pages, links).distinct().select(N.stable_key("host").alias("host_id"), "host"),
        "anchors": links.where("anchor is not null").select("anchor").distinct().select(N.stable_key("anchor").alias("anchor_id"), "anchor"),
    }


def collisions(table: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Ids of more than one value."""
    return table.groupBy(id_col).agg(F.countDistinct(value_col).alias("n_values")).where("n_values > 1")


def host_conflicts(pages: DataFrame, links: DataFrame) -> DataFrame:
    return url_sources(pages, links).groupBy("url").agg(F.countDistinct("host").alias("n_hosts")).where("n_hosts > 1")


def edges(links: DataFrame, buckets: int = 128) -> DataFrame:
    ids = links.select("crawl", N.stable_key("source_url").alias("source_url_id"), N.stable_key("target_url").alias("target_url_id"), N.stable_key("anchor").alias("anchor_id"), "crawled_at")
    # a power of two divides 2^64, so the signed key has the bucket of the unsigned id
    key = F.col("source_url_id") if buckets & (buckets - 1) == 0 else N.unsigned("source_url_id")
    return ids.withColumn("source_bucket", F.pmod(key, F.lit(buckets)).cast("int"))


def pages_optimized(pages: DataFrame, buckets: int = 128) -> DataFrame:
    """Pages by ids, dealt like the edges of their source."""
    out = pages.select("crawl", N.stable_key("source_url").alias("url_id"), "crawled_at", "status", "content_type", "title", "description", N.stable_key("canonical").alias("canonical_url_id"))
    key = F.col("url_id") if buckets & (buckets - 1) == 0 else N.unsigned("url_id")
    return out.withColumn("source_bucket", F.pmod(key, F.lit(buckets)).cast("int"))


def optimized(pages: DataFrame, links: DataFrame, crawl: str, path: str, buckets: int = 128) -> dict[str, int]:
    """Write crawls, dictionaries, edges and pages below `path`; row counts of each.

    Raises if a row is of another crawl, if two values share an id, if a URL has two
    hosts, or if edges or pages differ in number from their source.
    """
    spark = links.sparkSession
    foreign = links.select("crawl").unionByName(pages.select("crawl")).where(~F.col("crawl").eqNullSafe(F.lit(crawl)))
    if not foreign.isEmpty():
        raise ValueError("rows of another crawl")
    if not host_conflicts(pages, links).isEmpty():
        raise ValueError("a URL has two hosts")
    tables = dictionaries(pages, links) | {"crawls": spark.range(1).select(F.lit(1).cast("int").alias("crawl_id"), F.lit(crawl).alias("crawl"))}
    tables |= {"edges": edges(links, buckets), "pages_optimized": pages_optimized(pages, buckets)}
    rows = {}
    for name, table in tables.items():
        writer = table.repartition("source_bucket").write.partitionBy("source_bucket") if "source_bucket" in table.columns else sorted_dictionary(table).write
        writer.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/dataset={name}")
        rows[name] = spark.read.parquet(f"{path}/dataset={name}").count()
    for name, id_col, value in (("urls", "url_id", "url"), ("hosts", "host_id", "host"), ("anchors", "anchor_id", "anchor")):
        if not collisions(spark.read.parquet(f"{path}/dataset={name}"), id_col, value).isEmpty():
            raise ValueError(f"two values of {name} share an id")
    if rows["edges"] != links.count() or rows["pages_optimized"] != pages.count():
        raise ValueError("edges or pages are not as many as their source")
    return rows


def sorted_dictionary(table: DataFrame) -> DataFrame:
    """A dictionary in files of ascending values, so that row-group statistics prune a look-up; small ones stay one file."""
    value = next((c for c in ("url", "host", "anchor") if c in table.columns), table.columns[0])
    return table.repartitionByRange(value).sortWithinPartitions(value) if value in ("url", "host", "anchor") else table.coalesce(1)


def decode(edge: DataFrame, dictionary: dict[str, DataFrame]) -> DataFrame:
    """Links again: ids are looked up by equi-joins, which the planner broadcasts or shuffles by size."""
    urls, hosts = dictionary["urls"], dictionary["hosts"]
    named = urls.join(hosts, "host_id", "left")
    side = lambda s: named.select(F.col("url_id").alias(f"{s}_url_id"), F.col("url").alias(f"{s}_url"), F.col("host").alias(f"{s}_host"))
    out = edge.join(side("source"), "source_url_id", "left").join(side("target"), "target_url_id", "left").join(dictionary["anchors"], "anchor_id", "left")
    return out.select("crawl", "source_url", "source_host", "target_url", "target_host", "anchor", "crawled_at")
