"""Counts of operations: jobs, queues, progress, audits and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import seo
from ..functions import native as N


def status_histogram(pages: DataFrame, *by: str) -> DataFrame:
    """Pages by status as a map, and the bytes of all: the counts by status come first, so a crawl's map is of bounded size."""
    counts = pages.groupBy(*by, "status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("status").cast("string").alias("status"), "n")))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias("statuses"), F.sum("bytes").alias("bytes"))


def totals(users: DataFrame, websites: DataFrame, scans: DataFrame) -> DataFrame:
    """One row: users, websites, scans, and scans that completed or failed."""
    one = scans.agg(F.count("*").alias("scans"), F.count_if(F.col("status") == "completed").alias("completed_scans"), F.count_if(F.col("status") == "failed").alias("failed_scans")).withColumn("k", F.lit(1))
    for name, table in (("websites", websites), ("users", users)):
        one = one.join(F.broadcast(table.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))), "k")
    return one.select("users", "websites", "scans", "completed_scans", "failed_scans")


def queue_health(jobs: DataFrame, now: str, cap: int = 25) -> DataFrame:
    """Waiting jobs and jobs whose lease ran out, counted up to one more than the cap, and the age of the oldest waiting one."""
    at = F.lit(now).cast("timestamp")
    queued = F.col("status") == "queued"
    stale = F.col("status").isin("crawling", "analysing") & (F.col("lease_expires_at") <= at)
    capped = lambda x: F.least(F.count_if(x), F.lit(cap + 1))
    oldest = F.min(F.when(queued, F.col("created_at").cast("timestamp")))
    age = F.when(oldest.isNotNull(), F.greatest(F.lit(0), F.unix_millis(at) - F.unix_millis(oldest)))
    return jobs.agg(capped(queued).alias("pending"), age.alias("oldest_pending_ms"), capped(stale).alias("stale_leases"))


def oldest(jobs: DataFrame, condition: Column, order: str = "created_at", tie: str = "id") -> DataFrame:
    """The first job that meets a condition."""
    return jobs.where(condition).orderBy(order, tie).limit(1)


def newest_first(rows: DataFrame, order: str, tie: str = "id", most: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc(order), F.desc(tie))
    return out if most is None else out.limit(most)


#: Statuses of a job from its start to its end.
JOB_STATUSES = ("queued", "crawling", "analysing", "completed", "failed")


def job_state(events: DataFrame, attempts: int = 3) -> DataFrame:
    """The present status of each job out of its events (job_id, ts, seq, status): the last one, attempts being its starts.

    A job that was started as often as it may be and waits again counts as failed.
    """
    last = F.max_by("status", F.struct("ts", "seq"))
    out = events.where(F.col("status").isin(*JOB_STATUSES)).groupBy("job_id").agg(last.alias("status"), F.count_if(F.col("status") == "crawling").alias("attempts"), F.max("ts").alias("updated_at"))
    spent = (F.col("status") == "queued") & (F.col("attempts") >= attempts)
    return out.withColumn("status", F.when(spent, "failed").otherwise(F.col("status")))


def progress(metrics: DataFrame, total_inputs: int, recovered: int, seconds: float) -> DataFrame:
    """One row on a bounded run: what is done, the rates, and the time left, which is null before the first input."""
    failed = F.count_if(F.size("failures") > 0)
    m = metrics.agg(F.count("*").alias("attempted"), failed.alias("failed"), F.coalesce(F.sum("input_bytes"), F.lit(0)).alias("input_bytes"), F.coalesce(F.sum("links_emitted"), F.lit(0)).alias("links_emitted"))
    rate = F.col("attempted") / F.lit(float(seconds)) if seconds else F.lit(0.0)
    remaining = F.lit(total_inputs) - F.lit(recovered) - F.col("attempted")
    return m.select(
        F.lit(total_inputs).cast("long").alias("total_inputs"), (F.lit(recovered) + F.col("attempted")).alias("files_attempted"), (F.lit(recovered) + F.col("attempted") - F.col("failed")).alias("files_completed"), F.col("failed").alias("files_failed"),
        remaining.cast("long").alias("files_remaining"), "input_bytes", "links_emitted", F.round(rate * 3600, 3).alias("files_per_hour"),
        (F.round(F.col("input_bytes") / F.lit(float(seconds)) / (1 << 20), 3) if seconds else F.lit(0.0)).alias("input_mib_per_second"), F.when(rate > 0, F.round(remaining / rate, 3)).alias("remaining_seconds"),
    )


def tallies(issues: DataFrame, *by: str) -> DataFrame:
    """Issues by severity as a list shows them: warnings count as medium."""
    n = lambda *names: F.count_if(F.col("severity").isin(*names))
    return issues.groupBy(*by).agg(n("critical").alias("critical"), n("high").alias("high"), n("medium", "warning").alias("medium"), n("low").alias("low"))


def scan_snapshot(issues: DataFrame, pages: DataFrame, version: str = "1") -> DataFrame:
    """One row of a trend table for each scan: score, issues by severity, pages."""
    counts = seo.severity_counts(issues, "scan_id").drop("info")
    out = seo.scores(issues, pages).join(counts, "scan_id", "left").fillna(0, ["critical", "high", "medium", "low"])
    return out.select("scan_id", "score", F.lit(version).alias("rule_version"), F.col("failed").alias("issues"), "critical", "high", "medium", "low", "pages")


def checklist(pages: DataFrame) -> DataFrame:
    """(check, status, have, missing) of an audit; pages that failed count against the first check alone."""
    m = seo.coverage(pages).withColumn("k", F.lit(1)).join(F.broadcast(pages.agg(F.count("*").alias("attempted")).withColumn("k", F.lit(1))), "k")
    crawl = F.when(F.col("pages") == F.col("attempted"), "pass").when(F.col("pages") > 0, "warn").otherwise("fail")
    row = lambda name, status, have, of: F.struct(F.lit(name).alias("check"), status.alias("status"), F.col(have).alias("have"), (F.col(of) - F.col(have)).alias("missing"))
    rest = [row(name, F.when(F.col("pages") == F.col(have), "pass").otherwise("warn"), have, "pages") for name, have in (("canonical", "with_canonical"), ("titles", "with_title"), ("meta_desc", "with_description"), ("headings", "with_one_h1"))]
    return m.select(F.explode(F.array(row("crawlability", crawl, "pages", "attempted"), *rest)).alias("x")).select("x.*")


def suggested_fixes(issues: DataFrame) -> DataFrame:
    """Issues with a sentence on what to do."""
    return issues.withColumn("suggested_fix", F.concat(F.lit("Fix "), "title", F.lit(": "), "recommendation"))


def page_of(rows: DataFrame, size: int) -> DataFrame:
    """(total, pages) of a list: one page at least."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def unexpired(entries: DataFrame, now: str) -> DataFrame:
    """Cache entries that still hold."""
    return entries.where(F.col("expires_at") > F.lit(now).cast("timestamp"))


def lifecycle_resolved(history: DataFrame, key: dict, at: str) -> DataFrame:
    """The history after a user marks one issue as resolved."""
    chosen = F.lit(True)
    for column, value in key.items():
        chosen = chosen & F.col(column).eqNullSafe(F.lit(value))
    now = F.lit(at).cast("timestamp")
    return history.withColumns({"status": F.when(chosen, "resolved").otherwise(F.col("status")), "resolved_at": F.when(chosen, now).otherwise(F.col("resolved_at"))})


