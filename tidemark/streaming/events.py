"""Streaming forms of the event queries.

Every aggregate is windowed under a watermark, so state is dropped as event time
advances and never grows with the stream.  Distinct counts are exact: a key's
visitors are dealt to parts, so no state row holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def event_files(spark: SparkSession, path: str, schema, files: int = 100, only: str = "*.parquet") -> DataFrame:
    """Parquet files that land in a folder and whose names match `only`; `files` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", only).parquet(path)


def daily_trend(events: DataFrame, late: str = LATE, parts: int = 16) -> DataFrame:
    """(website_id, date, part, pageviews, visitors) by UTC day; `summed` adds the parts up.

    Visitors are counted exactly.  A visitor belongs to one part of a website's day,
    so no state row holds more than a share of them, and the parts add up.
    """
    part = F.pmod(F.xxhash64("visitor"), F.lit(parts)).cast("int")
    return (
        events.withWatermark("ts", late).groupBy("website_id", F.window("ts", "1 day").alias("w"), part.alias("part"))
        .agg(F.count("*").alias("pageviews"), F.size(F.collect_set("visitor")).cast("long").alias("visitors"))
        .select("website_id", F.date_format("w.start", "yyyy-MM-dd").alias("date"), "part", "pageviews", "visitors")
    )


def summed(trend: DataFrame) -> DataFrame:
    """Page views and visitors by website and day."""
    return trend.groupBy("website_id", "date").agg(F.sum("pageviews").alias("pageviews"), F.sum("visitors").alias("visitors"))


def page_views(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Views by page in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "page").agg(F.count("*").alias("views")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "page", "views")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions by inactivity of a visitor."""
    return events.withWatermark("ts", late).groupBy("visitor", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("pageviews")).select("visitor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pageviews")


def first_seen(events: DataFrame, *key: str, late: str = LATE) -> DataFrame:
    """Rows without repeats of a key; a repeat within the watermark's reach is dropped, and state lives no longer."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def retained(events: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Rows that retention keeps; the filter reaches the scan."""
    return events.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days"))


def limited(requests: DataFrame, millis: int, most: int, client: str = "client", late: str = LATE) -> DataFrame:
    """(client, request_id, ts, allowed): a limiter whose window starts at a client's first request.

    State is (start, used) per client and is dropped once the watermark passes the
    end of its window.  Rows of one batch are taken in order of (ts, request_id).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        allowed = []
        for at in rows["ts"].astype("datetime64[ms]").astype("int64"):
            if start is None or at >= start + millis:
                start, used = int(at), 0
            used += 1
            allowed.append(used <= most)
        state.update((start, used))
        state.setTimeoutTimestamp(max(start + millis, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"].array, "ts": rows["ts"].array, "allowed": allowed})

    slim = requests.withWatermark("ts", late).select(F.col(client).cast("string").alias("client"), F.col("request_id").cast("long").alias("request_id"), "ts")
    return slim.groupBy("client").applyInPandasWithState(step, "client string, request_id long, ts timestamp, allowed boolean", "start long, used long", "append", GroupStateTimeout.EventTimeTimeout)


def lifecycle(scans: DataFrame) -> DataFrame:
    """Issue events out of a stream of scans: (website_id, rule_id, affected_url, scan_no, ts, seen, root_ok).

    A scan says of each known issue whether it was seen.  Emits (key, scan_no,
    status, event); the state of an issue is its status alone, however long it lives.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else ""
        out = []
        for row in pd.concat(list(frames)).sort_values("scan_no").itertuples():
            event = None
            if row.seen and status != "active":
                event, status = ("detected" if not status else "reoccurred"), "active"
            elif not row.seen and status == "active" and row.root_ok:
                event, status = "resolved", "resolved"
            if event:
                out.append((*key, row.scan_no, status, event))
        state.update((status,))
        yield pd.DataFrame(out, columns=["website_id", "rule_id", "affected_url", "scan_no", "status", "event"])

    slim = scans.select(*[F.col(c).cast("string").alias(c) for c in ("website_id", "rule_id", "affected_url")], F.col("scan_no").cast("long").alias("scan_no"), "seen", "root_ok")
    kinds = "website_id string, rule_id string, affected_url string, scan_no long, status string, event string"
    return slim.groupBy("website_id", "rule_id", "affected_url").applyInPandasWithState(step, kinds, "status string", "append", GroupStateTimeout.NoTimeout)


def write_latest(stream: DataFrame, path: str, checkpoint: str, *key: str):
    """Start a query whose changed rows replace those of the same key; `read_latest` reads the table.

    The query runs in update mode, so state that the watermark passes is dropped.
    Each batch writes the next version of the table from the one before, so a
    repeated batch writes the same, and a batch that breaks off is not read.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < n]
        out = batch
        if before:
            old = spark.read.parquet(f"{path}/v={before[-1]}")
            changed = batch.select(F.struct(*key).alias("_key"))
            out = old.join(changed, F.struct(*key).eqNullSafe(F.col("_key")), "left_anti").unionByName(batch)
        out.write.mode("overwrite").parquet(f"{path}/v={n}")
        fs, root = _folder(spark, path)
        for v in before[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"v={v}"), True)

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end, ascending."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("v=")]
    return sorted(int(f.getName()[2:]) for f in found if fs.exists(done(f, "_SUCCESS")))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of a table."""
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")


def write(stream: DataFrame, path: str, checkpoint: str, *by: str, mode: str = "append"):
    """Start a Parquet sink; the checkpoint belongs in a shared folder, and only finished files are listed in the sink's log."""
    out = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (out.partitionBy(*by) if by else out).trigger(availableNow=True).start()
