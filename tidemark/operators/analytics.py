"""First-party web analytics over an event table: website_id, visitor, session, page, referrer, device, country, ts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native as N


def in_range(events: DataFrame, now: str, days: int = 30) -> DataFrame:
    days = N.clamp(days, 1, 90)
    return events.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def retained(events: DataFrame, now: str, days: int = 90) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def totals(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("pageviews"), F.countDistinct("visitor").alias("unique_visitors"), F.countDistinct("session").alias("unique_sessions"))


def top_pages(events: DataFrame, n: int = 10) -> DataFrame:
    """Most viewed pages with their share of all views in per cent, one decimal; the total is a one-row aggregate."""
    views = events.groupBy("page").agg(F.count("*").alias("views"))
    top = views.orderBy(F.desc("views"), "page").limit(n)
    total = events.agg(F.count("*").alias("total")).withColumn("k", F.lit(1))
    return top.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select("page", "views", (N.half_up(F.col("views") / F.col("total") * 1000) / 10).alias("share"))


def referrers(events: DataFrame, n: int = 10) -> DataFrame:
    name = F.when(F.col("referrer").isNull() | (F.col("referrer") == ""), "Direct / None").otherwise(F.coalesce(N.url_host("referrer"), F.col("referrer")))
    return events.groupBy(name.alias("referrer")).agg(F.count("*").alias("views")).orderBy(F.desc("views"), "referrer").limit(n)


def devices(events: DataFrame) -> DataFrame:
    """Views by device; desktop, mobile and tablet are there even without views."""
    seen = events.groupBy(F.coalesce("device", F.lit("desktop")).alias("device")).agg(F.count("*").alias("n"))
    seeds = events.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("desktop", "mobile", "tablet")))).alias("device")).withColumn("n", F.lit(0).cast("long"))
    return seen.unionByName(seeds).groupBy("device").agg(F.sum("n").alias("views"))


def daily_trend(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("pageviews"), F.countDistinct("visitor").alias("visitors")).orderBy("date")


def daily_aggregates(events: DataFrame) -> DataFrame:
    """One row per website and day, with nested views by device."""
    e = events.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).withColumn("device", F.coalesce("device", F.lit("desktop")))
    by_device = e.groupBy("website_id", "date", "device").agg(F.count("*").alias("n")).groupBy("website_id", "date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("device", "n")))).alias("device_breakdown"))
    return totals(e, "website_id", "date").join(by_device, ["website_id", "date"])


def dimension(events: DataFrame, dim: str) -> DataFrame:
    return events.groupBy(dim).agg(F.count("*").alias("views")).orderBy(F.desc("views"), F.col(dim).asc_nulls_last())
