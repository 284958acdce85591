"""Web-property reports: any dimensions and metrics, key figures of two periods, shares and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native as N

#: Names of events that count as conversions.
CONVERSIONS = ("purchase", "generate_lead", "sign_up", "conversion", "submit_form")


def report(rows: DataFrame, dims: list[str], metrics: dict[str, Column], order: list | None = None, limit: int | None = None) -> DataFrame:
    """Metrics (aggregates by name) by dimensions; ties of the order go by the dimensions."""
    out = rows.groupBy(*dims).agg(*[m.alias(name) for name, m in metrics.items()])
    if order:
        out = out.orderBy(*order, *dims)
    return out if limit is None else out.limit(limit)


def active_now(events: DataFrame, now: str, minutes: int = 30, *by: str) -> DataFrame:
    """Visitors of the last minutes, in all or by page."""
    at = F.lit(now).cast("timestamp")
    recent = events.where((F.col("ts") > at - F.expr(f"interval {int(minutes)} minutes")) & (F.col("ts") <= at))
    return recent.groupBy(*by).agg(F.countDistinct("visitor").alias("active_users"))


def percent_change(current, previous) -> Column:
    """Change in whole per cent, halves up; 0 where there was nothing before."""
    a, b = N.c(current), N.c(previous)
    return F.coalesce(F.when(b != 0, N.half_up((a - b) / b * 100)), F.lit(0)).cast("long")


def key_figures(current: DataFrame, previous: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, current, previous, pct_change) of two one-row frames."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("double").alias(name)) for m in metrics])).alias("x")).select("x.*")
    return long(current, "current").join(F.broadcast(long(previous, "previous")), "metric").withColumn("pct_change", percent_change("current", "previous"))


def device_share(rows: DataFrame) -> DataFrame:
    """Each device's share of the users in whole per cent; the total is a one-row aggregate."""
    total = rows.agg(F.coalesce(F.nullif(F.sum("users"), F.lit(0)), F.lit(1)).alias("total")).withColumn("k", F.lit(1))
    share = N.half_up(100 * F.col("users") / F.col("total")).cast("long")
    return rows.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select(*rows.columns, share.alias("share"))


def new_and_returning(rows: DataFrame) -> DataFrame:
    """Users whose type names "new" and the others; the mean session time is that of the last row by `_ord`."""
    new = F.lower("type").contains("new")
    return rows.agg(F.coalesce(F.sum(F.when(new, F.col("users"))), F.lit(0)).alias("new_users"), F.coalesce(F.sum(F.when(~new, F.col("users"))), F.lit(0)).alias("returning_users"), F.coalesce(F.max_by("avg_session_seconds", "_ord"), F.lit(0.0)).alias("avg_session_seconds"))


def sessions_per_user(sessions, users) -> Column:
    """With two decimals; 1 without users."""
    return F.when(N.c(users) != 0, F.round(N.c(sessions) / N.c(users), 2)).otherwise(F.lit(1.0))


def conversions(events: DataFrame, sessions: int) -> DataFrame:
    """Conversion events with their rate by session, to three decimals; 0 without sessions."""
    rate = F.round(F.col("count") / F.lit(sessions), 3) if sessions else F.lit(0.0)
    return events.where(F.lower("event_name").isin(*CONVERSIONS)).select("event_name", "count", rate.alias("rate"))


#: (kind, condition, how many): findings on landing pages, in the order of the rows.
FINDINGS = (("poor_engagement", "sessions >= 5 and engagement_rate < 0.4", 3), ("high_bounce", "sessions >= 5 and bounce_rate > 0.6", 3))


def insights(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, subject, label): the first landing pages of each finding and the first channel, all by `_ord`; each a limit of its own."""
    text = lambda x: F.concat(N.fixed(100 * F.col(x), 1), F.lit("%"))
    label = {"poor_engagement": F.concat(text("engagement_rate"), F.lit(" Engagement Rate")), "high_bounce": F.concat(text("bounce_rate"), F.lit(" Bounce Rate"))}
    out = sources.orderBy("_ord").limit(1).select(F.lit("growing_source").alias("kind"), F.col("channel").alias("subject"), F.concat(F.col("sessions").cast("string"), F.lit(" Sessions")).alias("label"))
    for kind, rule, n in FINDINGS:
        found = pages.where(rule).orderBy("_ord").limit(n)
        out = out.unionByName(found.select(F.lit(kind).alias("kind"), F.col("page").alias("subject"), label[kind].alias("label")))
    return out
