"""Streams against their batch forms over the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import events as S

START = dt.datetime(2026, 1, 1)
KINDS = "website_id long, visitor string, page string, ts timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = [(i % 2, f"v{i % 5}", f"/{i % 3}", START + dt.timedelta(minutes=17 * i)) for i in range(300)]
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], KINDS).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, stream, tmp_path, name, mode="complete"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_windows(spark, folder, tmp_path):
    batch = spark.read.parquet(folder)
    stream = lambda: S.event_files(spark, folder, KINDS, files=1)
    exact = batch.groupBy("website_id", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("pageviews"), F.countDistinct("visitor").alias("visitors"))
    same(S.summed(run(spark, S.daily_trend(stream(), parts=3), tmp_path, "trend")), exact)
    same(run(spark, S.page_views(stream(), "1 hour", "30 minutes"), tmp_path, "sliding"), S.page_views(batch, "1 hour", "30 minutes"))
    got = run(spark, S.visits(stream()), tmp_path, "visits")
    assert got.agg(F.sum("pageviews")).first()[0] == 300


def test_changed_rows_replace_those_of_their_key(spark, folder, tmp_path):
    stream = S.page_views(S.event_files(spark, folder, KINDS, files=1), "1 day")
    q = S.write_latest(stream, str(tmp_path / "t"), str(tmp_path / "c"), "start", "page")
    q.awaitTermination(120)
    assert q.exception() is None and len(q.recentProgress) >= 3
    same(S.read_latest(spark, str(tmp_path / "t")), S.page_views(spark.read.parquet(folder), "1 day"))


def test_first_seen_and_sink(spark, folder, tmp_path):
    out = str(tmp_path / "sink")
    q = S.write(S.first_seen(S.event_files(spark, folder, KINDS), "visitor", "ts"), out, str(tmp_path / "ck"), "website_id")
    q.awaitTermination(120)
    assert q.exception() is None and spark.read.parquet(out).count() == 300


def test_limiter_starts_at_first_request(spark, tmp_path):
    path = str(tmp_path / "req")
    seconds = {"a": [0, 30, 59, 60, 61, 150], "b": [5]}
    rows = [(c, i, START + dt.timedelta(seconds=s)) for c, ss in seconds.items() for i, s in enumerate(ss)]
    spark.createDataFrame(rows, "client string, request_id long, ts timestamp").coalesce(1).write.parquet(path)
    stream = S.limited(S.event_files(spark, path, "client string, request_id long, ts timestamp"), 60_000, 2)
    got = {(r.client, r.request_id): r.allowed for r in run(spark, stream, tmp_path, "limited", "append").collect()}
    assert [got["a", i] for i in range(6)] == [True, True, False, True, True, True] and got["b", 0]


def test_lifecycle(spark, tmp_path):
    path, kinds = str(tmp_path / "scans"), "website_id string, rule_id string, affected_url string, scan_no long, seen boolean, root_ok boolean"
    says = [(True, True), (True, True), (False, False), (False, True), (False, True), (True, True)]
    for i, (seen, ok) in enumerate(says):
        spark.createDataFrame([("w", "r", "u", i, seen, ok)], kinds).coalesce(1).write.mode("append").parquet(path)
    stream = S.lifecycle(S.event_files(spark, path, kinds, files=6))
    got = run(spark, stream, tmp_path, "life", "append").orderBy("scan_no").collect()
    assert [(r.scan_no, r.event, r.status) for r in got] == [(0, "detected", "active"), (3, "resolved", "resolved"), (5, "reoccurred", "active")]
