"""The link graph: bucketed details, exact roll-ups by host, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native as N

ORDER = ("target_host_bucket", "target_host", "source_host", "target_url", "anchor")


def details(links: DataFrame) -> DataFrame:
    """Rows with a target host, with its bucket; links are a multigraph and stay one."""
    return links.where(F.col("target_host").isNotNull() & (F.col("target_host") != "")).withColumn("target_host_bucket", N.host_bucket("target_host"))


def write_details(links: DataFrame, path: str, partitions: int = 1024, mode: str = "errorifexists", salts: int = 8) -> None:
    """Hive-partitioned by bucket, each file sorted by target host so that row-group statistics prune.

    Rows are dealt by bucket, host and a salt of the source, so neither a busy bucket
    nor a busy host is one task; a bucket has at most as many files as tasks meet it.
    """
    salt = F.pmod(F.xxhash64("source_url"), F.lit(salts))
    dealt = details(links).repartition(partitions, "target_host_bucket", "target_host", salt)
    dealt.sortWithinPartitions(*[F.col(x).asc_nulls_last() for x in ORDER]).write.mode(mode).option("compression", "zstd").partitionBy("target_host_bucket").parquet(path)


def read_details(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def of_host(detail: DataFrame, host: str) -> DataFrame:
    """The rows of one host: its bucket prunes partitions, its name prunes row groups."""
    return detail.where((F.col("target_host_bucket") == N.host_bucket(F.lit(host))) & (F.col("target_host") == host))


NONBLANK = "anchor is not null and length(trim(anchor)) > 0"


def host_summary(links: DataFrame, *by: str) -> DataFrame:
    """Exact counts; for many hosts at once group by the host.

    Rows are counted by host, referring host and page first, so each task sends one
    row of them.  Distinct referring hosts and pages are then the pairs without
    repeats; nothing is expanded once for each count.
    """
    pairs = links.groupBy(*by, "source_host", "target_url").agg(F.count("*").alias("n"), F.count_if(F.expr(NONBLANK)).alias("shown"))
    hosts = pairs.groupBy(*by, "source_host").agg(F.sum("n").alias("n"), F.sum("shown").alias("shown"))
    counted = hosts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observed_link_row_count"), F.count("source_host").alias("unique_referring_host_count"), F.coalesce(F.sum("shown"), F.lit(0)).alias("nonempty_anchor_row_count"))
    pages = pairs.where("target_url is not null").groupBy(*by, "target_url").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("*").alias("unique_target_page_count"))
    key = [F.lit(1).alias("k_0")] if not by else [F.coalesce(F.col(b), F.lit("")).alias(f"k_{i}") for i, b in enumerate(by)] + [F.col(b).isNull().alias(f"k_{len(by) + i}") for i, b in enumerate(by)]
    names = [f"k_{i}" for i in range(len(key))]
    out = counted.select("*", *key).join(pages.select(*key, "unique_target_page_count"), names, "left")
    return out.select(*by, "observed_link_row_count", "unique_referring_host_count", F.coalesce("unique_target_page_count", F.lit(0)).alias("unique_target_page_count"), "nonempty_anchor_row_count")


def host_rollup(detail: DataFrame, host: str, stage: str, destination: str, run_id: str, k: int = 100) -> dict:
    """Write the four roll-ups of one host and publish them in one step; what the manifest says of them.

    Raises for a host without a row, and where the destination is there already.
    The rows of one host are read once; all results but the referring hosts are bounded by `k`.
    """
    from . import manifests, quality

    spark = detail.sparkSession
    host = host.strip().lower()
    if not host or any(x.isspace() for x in host):
        raise ValueError("no host name")
    rows = of_host(detail, host).select("crawl", "source_host", "target_url", "anchor").persist()
    try:
        summary = host_summary(rows).first().asDict()
        if not summary["observed_link_row_count"]:
            raise LookupError(f"no link to {host}")
        bucket = detail.sparkSession.range(1).select(N.host_bucket(F.lit(host)).alias("b")).first()["b"]
        named = {c: F.lit(v) for c, v in (("run_id", run_id), ("target_host", host), ("target_host_bucket", bucket))}
        tables = {
            "domain-summary": host_summary(rows).withColumns(named),
            "referring-hosts": referring_hosts(rows.where("source_host is not null and source_host <> ''")).withColumn("target_host", F.lit(host)),
            "top-anchors": top_anchors(rows, k).withColumn("target_host", F.lit(host)),
            "top-linked-pages": top_linked_pages(rows, k).withColumn("target_host", F.lit(host)),
        }
        manifest = {"run_id": run_id, "target_host": host, "target_host_bucket": bucket, "top_k": k, "summary": summary}
        manifest["manifest_sha256"] = quality.self_hash(manifest)
        text = quality.canonical_json(manifest).decode()
        tables["manifest"] = spark.range(1).select(F.lit(text).alias("manifest"))
        manifests.publish(spark, tables, stage, destination)
    finally:
        rows.unpersist()
    return manifest


def referring_hosts(links: DataFrame) -> DataFrame:
    return links.groupBy("source_host").agg(F.count("*").alias("observed_link_row_count")).orderBy(F.desc("observed_link_row_count"), F.col("source_host").asc_nulls_last())


def top_anchors(links: DataFrame, k: int = 100) -> DataFrame:
    found = links.where(NONBLANK).groupBy("anchor").agg(F.count("*").alias("observed_link_row_count"))
    return found.orderBy(F.desc("observed_link_row_count"), "anchor").limit(_top(k))


def top_linked_pages(links: DataFrame, k: int = 100) -> DataFrame:
    found = links.where("target_url is not null and target_url <> ''").groupBy("target_url").agg(F.count("*").alias("observed_link_row_count"), F.countDistinct("source_host").alias("referring_host_count"))
    return found.orderBy(F.desc("observed_link_row_count"), "target_url").limit(_top(k))


def _top(k: int) -> int:
    if not 1 <= k <= 1000:
        raise ValueError("top_k must be between 1 and 1000")
    return k


def lookup(links: DataFrame, crawl: str, host: str, page: int = 1, size: int = 10, external_first: bool = False) -> DataFrame:
    """A page of links to one host.  By default the page is cut before internal links are dropped, so it may be short; with `external_first` it is full."""
    page, size = N.clamp(page, 1, 100), N.clamp(size, 1, 10)
    rows = links.where(F.col("crawl") == crawl)
    # over bucketed details the host's bucket prunes partitions
    rows = of_host(rows, host) if "target_host_bucket" in links.columns else rows.where(F.col("target_host") == host)
    external = N.external_link("source_host", "target_host")
    if external_first:
        rows = rows.where(external)
    rows = rows.orderBy("source_url", F.col("target_url").asc_nulls_last(), F.col("anchor").asc_nulls_last(), "crawled_at").offset((page - 1) * size).limit(size)
    return (rows if external_first else rows.where(external)).select("source_url", "source_host", "target_url", "anchor", "crawled_at")


def sample_rows(links: DataFrame, host: str, n: int = 20) -> DataFrame:
    if not 1 <= n <= 100:
        raise ValueError("limit must be between 1 and 100")
    return links.where(F.col("target_host") == host).limit(n)


def foreign_crawls(crawl: str, *tables: DataFrame) -> int:
    """Rows of another crawl in any of the tables; 0 when the input is pure."""
    every = tables[0].select("crawl")
    for t in tables[1:]:
        every = every.unionByName(t.select("crawl"))
    return every.where(~F.col("crawl").eqNullSafe(crawl)).count()
