"""Integrity checks, manifests and sharding."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import native as N


def canonical_json(value: dict, newline: bool = False) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode() + b"\n" * newline


def self_hash(manifest: dict, field: str = "manifest_sha256") -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in manifest.items() if k != field})).hexdigest()


def sharded(inputs: DataFrame, shards: int, order: str = "idx") -> DataFrame:
    """Contiguous balanced shards; the first ones get the rows that do not divide evenly. Inputs are a bounded list of files."""
    return inputs.withColumn("shard_id", F.ntile(shards).over(Window.orderBy(order)) - 1)


def cover_errors(base: DataFrame, shards: DataFrame, key: str = "path") -> DataFrame:
    """Paths that the shards miss, add or repeat."""
    a, b = base.groupBy(key).agg(F.count("*").alias("n_base")), shards.groupBy(key).agg(F.count("*").alias("n_shards"))
    return a.join(b, key, "full_outer").where("not (n_base <=> n_shards)")


def key_collisions(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.groupBy(N.input_key(path).alias("input_key")).agg(F.countDistinct(path).alias("n")).where("n > 1")


def incomplete_triplets(artifacts: DataFrame, kinds=("pages", "links", "metrics")) -> DataFrame:
    """(input_key, n): keys that have not one artifact of each kind; a key of other kinds alone has none."""
    seen = artifacts.groupBy("input_key").agg(F.countDistinct(F.when(F.col("dataset").isin(*kinds), F.col("dataset"))).alias("n"))
    return seen.where(F.col("n") < len(kinds))


def inventory_actions(source: DataFrame, target: DataFrame) -> DataFrame:
    """copy, verified, conflict or unexpected for each key of two inventories (key, sha256)."""
    j = source.select("key", F.col("sha256").alias("want")).join(target.select("key", F.col("sha256").alias("have")), "key", "full_outer")
    action = F.when(F.col("want").isNull(), "unexpected").when(F.col("have").isNull(), "copy").when(F.col("want") == F.col("have"), "verified").otherwise("conflict")
    return j.select("key", action.alias("action"))


def pending(inputs: DataFrame, done: DataFrame, key: str = "input") -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


def metrics_total(metrics: DataFrame) -> DataFrame:
    """Sums over inputs; the reduction ratio is null without input bytes and rounds halves to even."""
    names = ("input_bytes", "pages_emitted", "links_emitted", "output_bytes", "records_seen", "malformed_records", "malformed_json", "malformed_warc")
    s = metrics.agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names], F.count_if(F.size("failures") > 0).alias("failed_inputs"))
    return s.withColumn("reduction_ratio", F.when(F.col("input_bytes") > 0, F.bround(1 - F.col("output_bytes") / F.col("input_bytes"), 6)))


def violations(table: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(check, n): rows that break each named SQL condition, in one pass."""
    counted = table.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in checks.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")


def missing_buckets(detail: DataFrame, buckets: int = 1024) -> DataFrame:
    every = detail.sparkSession.range(buckets).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("target_host_bucket"))
    return every.join(detail.select("target_host_bucket").distinct(), "target_host_bucket", "left_anti")


def quota(requests: DataFrame, user: str, ts: str, millis: int, most: int) -> DataFrame:
    """Requests with whether they fit the quota of their user's fixed window; those without a time or an id come last."""
    w = Window.partitionBy(user, "window_id").orderBy(F.asc_nulls_last(ts), F.asc_nulls_last("request_id"))
    out = requests.withColumn("window_id", N.window_id(ts, millis))
    return out.withColumn("allowed", F.row_number().over(w) <= most)
