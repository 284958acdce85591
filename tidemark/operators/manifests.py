"""Lists of inputs and their shards, dataset summaries, and publication in stages.

Lists of inputs are bounded (tens of thousands of paths); datasets are not, and
are summed up by tasks that read footers or stream bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native as N

#: Files that one shard of links may have.
MOST_FILES = 1000


def input_list(spark: SparkSession, path: str, given: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(idx, path): given paths, then the non-blank lines of a list (plain or gzip) in their order; the first `most` of them.

    One task reads a list file from its start, so line numbers follow from the order within the task.
    """
    lines = spark.read.text(path).coalesce(1).select(F.trim("value").alias("path"), F.monotonically_increasing_id().alias("at")).where("path <> ''")
    own = spark.range(1).select(F.posexplode(F.array(*map(F.lit, given))).alias("at", "path")) if given else None
    every = lines.select(F.lit(1).alias("list"), "at", "path")
    if own is not None:
        every = own.select(F.lit(0).alias("list"), F.col("at").cast("long"), "path").unionByName(every)
    ordered = F.array_sort(F.collect_list(F.struct("list", "at", "path")))
    out = every.agg(ordered.alias("x")).select(F.posexplode("x").alias("idx", "r")).select("idx", "r.path")
    return out if most is None else out.where(F.col("idx") < most)


def chunked(rows: DataFrame, size: int, order: str = "idx") -> DataFrame:
    """Rows with the number of their chunk of `size`; `order` counts from 0."""
    return rows.withColumn("chunk", F.floor(F.col(order) / size).cast("long"))


def can_promote(existing: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: whether the existing list (idx, path) is an ordered prefix of the requested one, and how many paths break that."""
    j = existing.select("idx", F.col("path").alias("had")).join(requested.select("idx", F.col("path").alias("wants")), "idx", "left")
    broken = F.count_if(~F.col("had").eqNullSafe(F.col("wants")))
    return j.agg(broken.alias("broken")).select((F.col("broken") == 0).alias("can_promote"), "broken")


def shard_entries(shards: DataFrame) -> DataFrame:
    """A plan's entry for each shard of (shard_id, idx, path): how many inputs, the first, the last, and the digest of all."""
    return shards.groupBy("shard_id").agg(F.count("*").alias("input_count"), F.min_by("path", "idx").alias("first_input"), F.max_by("path", "idx").alias("last_input"), N.inputs_sha256("path", "idx").alias("inputs_sha256"))


def binding_errors(plan: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard_id, field) where a plan's entry and the shard's own differ; a missing side differs in all fields."""
    fields = ("input_count", "first_input", "last_input", "inputs_sha256")
    side = lambda df, name: df.select("shard_id", F.struct(*fields).alias(name))
    j = side(plan, "want").join(side(shard_entries(shards), "have"), "shard_id", "full_outer")
    bad = F.array_compact(F.array(*[F.when(~F.col(f"want.{f}").eqNullSafe(F.col(f"have.{f}")), F.lit(f)) for f in fields]))
    return j.select("shard_id", F.explode(bad).alias("field"))


def slice_faults(inputs: DataFrame, first: DataFrame, shards: DataFrame, plan: DataFrame) -> DataFrame:
    """One row on a second slice of inputs: paths that the first one has too, paths that its shards miss or add, entries that differ from the plan."""
    overlap = inputs.join(first.select("path"), "path", "left_semi").agg(F.count("*").alias("overlap"))
    a, b = inputs.groupBy("path").agg(F.count("*").alias("n_base")), shards.groupBy("path").agg(F.count("*").alias("n_shards"))
    uncovered = a.join(b, "path", "full_outer").where("not (n_base <=> n_shards)").agg(F.count("*").alias("uncovered"))
    unbound = binding_errors(plan, shards).agg(F.count("*").alias("unbound"))
    one = overlap.withColumn("k", F.lit(1))
    for other in (uncovered, unbound):
        one = one.join(F.broadcast(other.withColumn("k", F.lit(1))), "k")
    return one.drop("k")


def list_faults(inputs: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """One row: paths of a wrong form, paths that repeat, and keys that two paths share."""
    wrong = ~F.col("path").startswith(prefix) | ~F.col("path").endswith(suffix)
    counted = inputs.groupBy("path").agg(F.count("*").alias("n"))
    keys = counted.groupBy(N.input_key("path").alias("key")).agg(F.count("*").alias("n_paths"), F.sum("n").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(F.col("n") > 1).alias("repeated"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inputs"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong_form"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"), F.count_if(F.col("n_paths") > 1).alias("shared_keys"))


def _files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, bytes) below a folder; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("bytes"))


def file_digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file below a folder; each is streamed by one task in blocks, whatever its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                where, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                digest = hashlib.sha256()
                with where.open_input_stream(inner) as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "bytes", "sha256"])

    return _files(spark, root, pattern).mapInArrow(run, "path string, bytes long, sha256 string")


def footers(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, rows, row_groups, codecs, encodings) of every Parquet file, read from its footer alone; encodings by column of the first row group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                where, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with where.open_input_file(inner) as f:
                    m = pq.ParquetFile(f).metadata
                first = [m.row_group(0).column(i) for i in range(m.num_columns)] if m.num_row_groups else []
                out.append((m.num_rows, m.num_row_groups, sorted({x.compression for x in first}), [{"column": x.path_in_schema, "encodings": sorted(x.encodings)} for x in first]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("column", pa.string()), ("encodings", pa.list_(pa.string()))])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["path", "bytes", "rows", "row_groups", "codecs", "encodings"])

    return _files(spark, root).mapInArrow(run, "path string, bytes long, rows long, row_groups long, codecs array<string>, encodings array<struct<column:string,encodings:array<string>>>")


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, rows, sha256) of every Parquet file below a folder, paths in order."""
    digests = file_digests(spark, root, "*.parquet").select("path", "sha256")
    return footers(spark, root).select("path", "bytes", "rows").join(digests, "path").orderBy("path")


def read_flat(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of folders or patterns, whose folder names become no columns."""
    return spark.read.option("recursiveFileLookup", True).parquet(*paths)


def dataset_summary(spark: SparkSession, root: str, digest: bool = True) -> DataFrame:
    """One row on a Parquet tree: bytes, files, rows, row groups, codecs, the encodings of the first file, and the digest of all paths and contents."""
    own = footers(spark, root)
    relative = F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    out = own.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("row_groups"), F.lit(0)).alias("row_groups"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("codecs")))).alias("codecs"), F.min_by("encodings", "path").alias("encodings"),
    )
    if not digest:
        return out
    lines = F.array_sort(F.collect_list(F.struct(relative.alias("p"), "sha256")))
    tree = file_digests(spark, root, "*.parquet").agg(F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x["p"], F.lit("\0"), x["sha256"], F.lit("\n"))), ""), 256).alias("sha256"))
    return out.withColumn("k", F.lit(1)).join(F.broadcast(tree.withColumn("k", F.lit(1))), "k").drop("k")


def file_count(spark: SparkSession, root: str, expected: int | None = None) -> int:
    """Files of a shard; raises beyond MOST_FILES or where they are not as many as expected."""
    n = _files(spark, root).count()
    if n > MOST_FILES or (expected is not None and n != expected):
        raise ValueError(f"{n} files below {root}")
    return n


def write_single(table: DataFrame, path: str) -> None:
    """One Parquet file in a folder; for results of bounded size."""
    table.coalesce(1).write.mode("errorifexists").parquet(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], stage: str, destination: str) -> None:
    """Write bounded tables below a staging folder, then rename it into place; a destination that is there already is refused.

    Readers see all of it or nothing, and a run that breaks off leaves the destination alone.
    """
    jvm = spark.sparkContext._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(destination), jvm.org.apache.hadoop.fs.Path(stage)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(destination)
    for name, table in tables.items():
        write_single(table, f"{stage}/dataset={name}")
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{destination} was not published")
