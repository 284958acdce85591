"""Stand-in views: the library's data model over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRAWL = "CC-STAND"
HOST = "t27.example.org"

LINKS_SQL = f"""links AS (
  SELECT '{CRAWL}' AS crawl, 's' || (l_suppkey % 40) || '.example.com' AS source_host,
         'https://s' || (l_suppkey % 40) || '.example.com/o/' || l_orderkey AS source_url,
         CASE l_linenumber WHEN 3 THEN 'www.s' || (l_suppkey % 40) || '.example.com' WHEN 4 THEN NULL ELSE 't' || (l_partkey % 97) || '.example.org' END AS target_host,
         'https://' || CASE l_linenumber WHEN 3 THEN 'www.s' || (l_suppkey % 40) || '.example.com' WHEN 4 THEN NULL ELSE 't' || (l_partkey % 97) || '.example.org' END || '/p/' || (l_partkey % 500) AS target_url,
         CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE l_returnflag || l_linestatus END AS anchor, l_shipdate AS crawled_at
  FROM lineitem)"""

FACTS_SQL = """facts AS (
  SELECT p_type || '-' || (l_partkey % 40) AS query, '/' || p_brand AS page, CAST(l_shipdate AS DATE) AS date, l_partkey,
         CASE WHEN (l_orderkey % 10) < (l_partkey % 4) AND l_discount >= 0.05 THEN 1 ELSE 0 END AS click, CAST(1 + ((l_partkey * 7 + l_linenumber) % 25) AS DOUBLE) AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

EVENTS_SQL = """ev AS (
  SELECT user_id % 3 AS website_id, CAST(user_id AS VARCHAR) AS visitor, CAST(user_id AS VARCHAR) || '-' || CAST(ts AS DATE) AS session, '/' || event_type AS page,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'https://Ref' || (event_id % 7) || '.example.net/x' END AS referrer,
         CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'mobile' ELSE 'desktop' END AS device, ts
  FROM events)"""

SCANS_SQL = """scans AS (
  SELECT 'w' || (o_custkey % 5) AS website_id, o_orderpriority AS rule_id, 'https://c.example/' || o_custkey AS affected_url,
         CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS scan_no, o_orderdate AS created_at, o_orderkey AS scan_id FROM orders)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def links(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".example.com"))
    target = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("www."), source)).when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.concat(F.lit("t"), (F.col("l_partkey") % 97).cast("string"), F.lit(".example.org")))
    return table(spark, sf, "lineitem").select(
        F.lit(CRAWL).alias("crawl"), source.alias("source_host"), F.concat(F.lit("https://"), source, F.lit("/o/"), F.col("l_orderkey").cast("string")).alias("source_url"),
        target.alias("target_host"), F.concat(F.lit("https://"), target, F.lit("/p/"), (F.col("l_partkey") % 500).cast("string")).alias("target_url"),
        F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, "  ").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("anchor"), F.col("l_shipdate").alias("crawled_at"),
    )


def link_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = links(spark, sf).where("source_url like '%7'").select("crawl", "source_url", "source_host").distinct()
    return p.withColumn("canonical", F.concat("source_url", F.lit("?c")))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    click = F.when(((F.col("l_orderkey") % 10) < (F.col("l_partkey") % 4)) & (F.col("l_discount") >= 0.05), 1).otherwise(0)
    return j.select(F.concat("p_type", F.lit("-"), (F.col("l_partkey") % 40).cast("string")).alias("query"), F.concat(F.lit("/"), "p_brand").alias("page"), F.to_date("l_shipdate").alias("date"), "l_partkey", click.alias("click"), (1 + ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 25)).cast("double").alias("pos"))


def current(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).where("date >= date'1998-06-01' and date < date'2001-12-01'")


def previous(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).where("date >= date'1994-12-01' and date < date'1998-06-01' and l_partkey % 40 <> 0")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return event_columns(table(spark, sf, "events"))


def event_columns(e: DataFrame) -> DataFrame:
    user = F.col("user_id").cast("string")
    referrer = F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://Ref"), (F.col("event_id") % 7).cast("string"), F.lit(".example.net/x")))
    device = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, "mobile").otherwise("desktop")
    return e.select((F.col("user_id") % 3).alias("website_id"), user.alias("visitor"), F.concat(user, F.lit("-"), F.to_date("ts").cast("string")).alias("session"), F.concat(F.lit("/"), "event_type").alias("page"), referrer.alias("referrer"), device.alias("device"), "ts")


def scans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.concat(F.lit("w"), (F.col("o_custkey") % 5).cast("string")).alias("website_id"), F.col("o_orderpriority").alias("rule_id"), F.concat(F.lit("https://c.example/"), F.col("o_custkey").cast("string")).alias("affected_url"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2).alias("scan_no"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("scan_id"))


def audited_pages(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import seo

    p = seo.parsed(table(spark, sf, "pages"))
    null = F.lit(None).cast("string")
    status = F.when(F.col("page_id") % 17 == 0, 404).when(F.col("page_id") % 23 == 0, 500).otherwise(200)
    return p.select((F.col("page_id") % 4).alias("scan_id"), F.col("url"), F.lit("example.com").alias("hostname"), status.alias("status"), ((F.col("page_id") * 37) % 2000).alias("response_ms"), F.lit(True).alias("parsed"), "title", "description", "canonical", null.alias("canonical_error"), "noindex", "h1", F.lit(True).alias("jsonld_valid"))
