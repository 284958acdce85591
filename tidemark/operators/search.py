"""Search-performance analytics: comparison of two periods, and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import native as N

METRICS = ("clicks", "impressions", "ctr", "position")


def report(facts: DataFrame, dims: list[str]) -> DataFrame:
    """Clicks, impressions, rate and mean position by any dimensions."""
    out = facts.groupBy(*dims).agg(F.sum("click").cast("double").alias("clicks"), F.count("*").cast("double").alias("impressions"), F.avg("pos").alias("position"))
    return out.withColumn("ctr", N.ratio("clicks", "impressions")).select(*dims, *METRICS)


def overview(rows: DataFrame) -> DataFrame:
    """Totals, with the position weighted by impressions; all zeros for no rows."""
    s = rows.agg(F.coalesce(F.sum("clicks"), F.lit(0.0)).alias("clicks"), F.coalesce(F.sum("impressions"), F.lit(0.0)).alias("impressions"), F.coalesce(F.sum(F.col("position") * F.col("impressions")), F.lit(0.0)).alias("weighted"))
    return s.select("clicks", "impressions", N.ratio("clicks", "impressions").alias("ctr"), N.ratio("weighted", "impressions").alias("position"))


def compared(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Current rows with structs `previous` and `change`; both null where the period before has no row. Of repeated earlier keys the last by `_ord` counts, or without that column the greatest by its metrics."""
    order = F.col("_ord") if "_ord" in previous.columns else F.struct(*METRICS)
    last = previous.groupBy(key).agg(F.max_by(F.struct(*METRICS), order).alias("previous"))
    out = current.join(last, key, "left")
    change = F.struct(*[(F.col(m) - F.col(f"previous.{m}")).alias(m) for m in METRICS])
    return out.withColumn("change", F.when(F.col("previous").isNotNull(), change))


def _first(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def quick_wins(rows: DataFrame, key: str = "query", n: int = 8) -> DataFrame:
    return _first(rows.where((F.col("impressions") >= 50) & F.col("position").between(4, 20)), [F.desc("impressions"), key], n)


def ctr_opportunities(rows: DataFrame, key: str = "query", n: int = 8) -> DataFrame:
    return _first(rows.where((F.col("impressions") >= 100) & (F.col("position") <= 10) & (F.col("ctr") < 0.03)), [F.desc("impressions"), key], n)


def content_decay(rows: DataFrame, key: str = "page", n: int = 8) -> DataFrame:
    lost = rows.where(F.col("previous").isNotNull() & (F.col("previous.clicks") >= 5) & (F.col("clicks") < F.col("previous.clicks")))
    return _first(lost, [F.col("change.clicks").asc(), key], n)


def winners(rows: DataFrame, key: str = "query", n: int = 8) -> DataFrame:
    return _first(rows.where("change is not null and change.clicks > 0"), [F.desc("change.clicks"), key], n)


def losers(rows: DataFrame, key: str = "query", n: int = 8) -> DataFrame:
    return _first(rows.where("change is not null and change.clicks < 0"), [F.col("change.clicks").asc(), key], n)


def cannibalisation(rows: DataFrame, n: int = 8, top: int = 5) -> DataFrame:
    """Queries that several pages compete for, with their `top` pages by impressions."""
    w = Window.partitionBy("query").orderBy(F.desc("impressions"), "page")
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    out = ranked.groupBy("query").agg(F.count("*").alias("page_count"), F.sum("clicks").alias("total_clicks"), F.sum("impressions").alias("total_impressions"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= top, F.struct("_rank", "page", "impressions")))).alias("pages"))
    kept = out.where((F.col("page_count") >= 2) & (F.col("total_impressions") >= 20)).withColumn("pages", F.transform("pages", lambda x: x["page"]))
    return _first(kept, [F.desc("total_impressions"), "query"], n)


OPPORTUNITIES = (
    ("low_ctr", "impressions >= 40 and ctr < 0.025", 5),
    ("striking_distance", "position between 8 and 20 and impressions >= 15", 5),
    ("zero_clicks", "impressions >= 25 and clicks = 0", 5),
    ("top_performing", "clicks >= 5 and ctr >= 0.05", 3),
)


def opportunities(rows: DataFrame, order: str = "query") -> DataFrame:
    """The first rows of each kind in source order, which `order` stands for; one pass over the rows."""
    kinds = F.filter(F.array(*[F.when(F.expr(p), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("most"))) for k, p, n in OPPORTUNITIES]), lambda x: x.isNotNull())
    found = rows.withColumn("k", F.explode(kinds)).select("*", "k.kind", "k.most")
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(order)))
    # the constant bound lets every task keep its first rows alone before they are shuffled
    return ranked.where(F.col("_n") <= max(n for _, _, n in OPPORTUNITIES)).where("_n <= most").select("kind", order, *METRICS)


def periods(as_of: str, days: int) -> tuple[str, str, str, str]:
    """(current from, to, previous from, to): the current one ends two days before `as_of`."""
    import datetime as dt

    days = N.clamp(days, 7, 90)
    to = dt.date.fromisoformat(as_of) - dt.timedelta(2)
    start = to - dt.timedelta(days - 1)
    return tuple(d.isoformat() for d in (start, to, start - dt.timedelta(days), start - dt.timedelta(1)))


def property_match(sites: DataFrame, host: str) -> DataFrame:
    """The best property of a host: its domain property, that without www, else a URL prefix of it."""
    bare = host.removeprefix("www.")
    s = F.col("site")
    own = N.url_host(s)
    rank = F.when(s == f"sc-domain:{host}", 1).when(s == f"sc-domain:{bare}", 2).when((own == host) | (F.regexp_replace(own, r"^www\.", "") == bare), 3)
    return sites.withColumn("priority", rank).where("priority is not null").orderBy("priority", "site").limit(1)


def full_report_totals(queries: DataFrame, daily: DataFrame) -> DataFrame:
    """Sums over queries, or over days where those are 0; the position is a plain mean."""
    sums = lambda df: df.agg(F.coalesce(F.sum("clicks"), F.lit(0.0)).alias("c"), F.coalesce(F.sum("impressions"), F.lit(0.0)).alias("i"), F.avg("position").alias("p"))
    q, d = sums(queries).select(F.struct("*").alias("q")), sums(daily).select(F.struct("*").alias("d"))
    one = q.withColumn("k", F.lit(1)).join(F.broadcast(d.withColumn("k", F.lit(1))), "k")
    pick = lambda f: F.when(F.col(f"q.{f}") != 0, F.col(f"q.{f}")).otherwise(F.col(f"d.{f}"))
    out = one.select(pick("c").alias("clicks"), pick("i").alias("impressions"), F.coalesce("q.p", "d.p", F.lit(0.0)).alias("position"))
    return out.select("clicks", "impressions", N.ratio("clicks", "impressions").alias("ctr"), "position")


def indexing_overview(scans: DataFrame) -> DataFrame:
    """What the latest scan of each website says of its index: scans has website_id, pages, critical and high."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scans.select("website_id", F.greatest(zero(F.col("pages")) - zero(F.col("critical")), F.lit(0)).alias("indexed_pages"), zero(F.col("critical")).alias("not_indexed"), zero(F.col("critical")).alias("errors"), zero(F.col("high")).alias("excluded"))


def keyword_list(facts: DataFrame, as_of: str, days: int = 28, most: int = 100) -> DataFrame:
    """Queries of the last days by clicks, then impressions; ties by name."""
    start = F.lit(as_of).cast("date") - F.expr(f"interval {int(days)} days")
    rows = report(facts.where((F.col("date") >= start) & (F.col("date") <= F.lit(as_of).cast("date"))), ["query"])
    return rows.orderBy(F.desc("clicks"), F.desc("impressions"), "query").limit(most)


def both_sections(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """Query rows, then page rows: (section, key, metrics, _ord), in that order."""
    one = lambda df, name, key, at: df.select(F.lit(name).alias("section"), F.col(key).alias("key"), *METRICS, F.struct(F.lit(at).alias("section"), F.col(key).alias("key")).alias("_ord"))
    return one(queries, "query", "query", 0).unionByName(one(pages, "page", "page", 1))


def scale(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """The greatest value of a series, one at least: what a chart is scaled by."""
    return rows.groupBy(*by).agg(F.greatest(F.coalesce(F.max(column), F.lit(1)), F.lit(1)).alias("scale"))
