"""Differences between scans and the life of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("website_id", "rule_id", "affected_url")


def differences(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """(key, change): "new" or "removed"; keys are compared as sets in one full join."""
    a, b = new.select(*key).distinct().withColumn("_new", F.lit(True)), old.select(*key).distinct().withColumn("_old", F.lit(True))
    out = a.join(b, list(key), "full_outer").where("_new is null or _old is null")
    return out.select(*key, F.when(F.col("_new").isNotNull(), "new").otherwise("removed").alias("change"))


def latest(scans: DataFrame, by: str = "website_id", order: str = "created_at", tie: str = "scan_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return scans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_previous(rankings: DataFrame) -> DataFrame:
    """Each ranking with the position before it, unless it names one itself."""
    w = Window.partitionBy("keyword_id").orderBy("created_at", "ranking_id")
    given = F.col("previous_position") if "previous_position" in rankings.columns else F.lit(None).cast("int")
    return rankings.withColumn("previous_position", F.coalesce(given, F.lag("position").over(w)))


def lifecycle(history: DataFrame, found: DataFrame, scan_id: str, at: str, root_ok: bool = True, events: int = 100) -> DataFrame:
    """The history after a scan.

    A new issue becomes active; an active one that is seen again only moves its
    last date; a resolved one reoccurs; an active one that is not seen is resolved
    if the root page was fetched.  At most the last `events` events stay.
    """
    now = F.lit(at).cast("timestamp")
    event = lambda name: F.array(F.struct(F.lit(name).alias("event"), now.alias("timestamp"), F.lit(scan_id).alias("scan_id")))
    seen = found.select(*KEY).distinct().withColumn("_seen", F.lit(True))
    j = history.withColumn("_had", F.lit(True)).join(seen, list(KEY), "full_outer")
    is_new = F.col("_had").isNull()
    again = F.col("_had") & F.coalesce("_seen", F.lit(False)) & (F.col("status") == "resolved")
    gone = F.col("_had") & F.col("_seen").isNull() & (F.col("status") == "active") & F.lit(root_ok)
    seen_now = F.coalesce("_seen", F.lit(False))
    none = F.expr("cast(array() as array<struct<event:string,timestamp:timestamp,scan_id:string>>)")
    log = F.concat(F.coalesce("events", none), F.when(is_new, event("detected")).when(again, event("reoccurred")).when(gone, event("resolved")).otherwise(none))
    return j.select(
        *KEY,
        F.when(is_new | again, "active").when(gone, "resolved").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_detected_at", now).alias("first_detected_at"),
        F.when(seen_now, now).otherwise(F.col("last_detected_at")).alias("last_detected_at"),
        F.when(gone, now).when(again, F.lit(None).cast("timestamp")).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.when(again, now).otherwise(F.col("reoccurred_at")).alias("reoccurred_at"),
        F.when(F.size(log) > events, F.slice(log, -events, events)).otherwise(log).alias("events"),
    )


def upsert(table: DataFrame, changes: DataFrame, key: list[str], insert_only: tuple[str, ...] = ()) -> DataFrame:
    """The table after an update-or-insert; `insert_only` columns keep what they had."""
    other = [c for c in table.columns if c not in key]
    j = table.withColumn("_old", F.lit(True)).join(changes.select(*key, *[F.col(c).alias(f"n_{c}") for c in other if c in changes.columns]).withColumn("_new", F.lit(True)), key, "full_outer")
    pick = lambda c: F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c in insert_only)), F.col(c)).otherwise(F.col(f"n_{c}")) if c in changes.columns else F.col(c)
    return j.select(*key, *[pick(c).alias(c) for c in other])


def scan_difference(website: str, scan: str, old_issues: DataFrame, new_issues: DataFrame, old_pages: DataFrame, new_pages: DataFrame, at: str, most: int = 50) -> DataFrame:
    """One row on a scan against the one before: new and resolved issues, new and removed pages, counted, and the first `most` of each by name.

    Issues go by rule and address, pages by address; all four lists are top-k aggregates of one pass over the differences.
    """
    issue = lambda df: df.select(F.concat_ws(":", "rule_id", "affected_url").alias("key"))
    kinds = differences(issue(old_issues), issue(new_issues), "key").select("key", F.when(F.col("change") == "new", "new_issues").otherwise("resolved_issues").alias("kind"))
    pages = differences(old_pages.select(F.col("url").alias("key")), new_pages.select(F.col("url").alias("key")), "key")
    kinds = kinds.unionByName(pages.select("key", F.when(F.col("change") == "new", "new_pages").otherwise("removed_pages").alias("kind")))
    ranked = kinds.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("key"))).where(F.col("_n") <= most)
    names = ("new_issues", "resolved_issues", "new_pages", "removed_pages")
    counts = kinds.agg(*[F.count_if(F.col("kind") == n).alias(f"{n}_count") for n in names]).withColumn("k", F.lit(1))
    firsts = ranked.agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == n, F.col("key")))).alias(n) for n in names]).withColumn("k", F.lit(1))
    out = counts.join(F.broadcast(firsts), "k").drop("k")
    return out.select(F.lit(website).alias("website_id"), F.lit(scan).alias("scan_id"), *out.columns, F.lit(at).cast("timestamp").alias("created_at"))


def written(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table after inserts, replacements and deletes: `changes` has the table's columns and `op` (insert, replace or delete).

    An insert of a key that is there is left out, as is a replacement of one that is not.
    """
    j = table.withColumn("_had", F.lit(True)).join(changes.select(*key, "op", F.struct(*[F.col(c) for c in table.columns]).alias("_new")), key, "full_outer")
    had, op = F.coalesce("_had", F.lit(False)), F.coalesce("op", F.lit("keep"))
    stays = F.when(had, op != "delete").otherwise(op == "insert")
    pick = lambda c: F.when(had & (op != "replace"), F.col(c)).otherwise(F.col("_new")[c]) if c not in key else F.col(c)
    return j.where(stays).select(*[pick(c).alias(c) for c in table.columns])


def reachable(links: DataFrame, start: list[str], depth: int = 5, pages: int = 25) -> DataFrame:
    """(url, depth) by breadth-first search; each level is one join and `pages` bounds both the frontier and what is found.

    A level has at most a few times `pages` rows, which become literals of the next
    plan: no cache is held and no lineage grows with the depth.
    """
    spark = links.sparkSession
    rows = lambda found: spark.createDataFrame(found, "url string, depth int")
    seen = [(u, 0) for u in sorted(set(start))[:pages]]
    frontier = [u for u, _ in seen]
    for level in range(1, depth + 1):
        known = rows(seen).select("url")
        step = links.join(F.broadcast(rows([(u, 0) for u in frontier]).select(F.col("url").alias("source_url"))), "source_url", "left_semi").select(F.col("target_url").alias("url")).where("url is not null").distinct()
        frontier = [r.url for r in step.join(F.broadcast(known), "url", "left_anti").orderBy("url").limit(2 * pages).collect()]
        if not frontier:
            break
        seen = sorted(seen + [(u, level) for u in frontier], key=lambda x: (x[1], x[0]))[:pages]
    return rows(seen)
