"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


class Workspace:
    """Written tables that cut lineage: a lost executor costs a re-read, not a re-run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Free tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Free the shuffle files of queries that are done.

        Spark frees a shuffle once the driver has collected its handle, which a
        driver with room to spare would put off; called after large shuffles only.
        """
        self.spark.sparkContext._jvm.System.gc()


#: Rows of one long that may be broadcast: 8 MB of ids.
BROADCAST_IDS = 1_000_000


def join_ids(big: DataFrame, ids: DataFrame, on: str, rows: int, how: str = "inner") -> DataFrame:
    """Join to a table of ids whose row count is known: broadcast below BROADCAST_IDS, shuffled beyond."""
    return big.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids, on, how)


def row_number(id_col: str | Column, text_col: str | Column, seed: int = 0) -> Column:
    """A number of a row by its doc_id and text, null ids and texts included."""
    i, t = (F.col(c) if isinstance(c, str) else c for c in (id_col, text_col))
    return F.xxhash64(*([F.lit(seed)] if seed else []), i.cast("long"), i.isNull(), t.cast("string"), t.isNull())


def row_keys(id_col: str | Column, text_col: str | Column) -> list[Column]:
    """Two independent numbers of a row, named row and row2: 128 bits, so that no two rows share them."""
    return [row_number(id_col, text_col).alias("row"), row_number(id_col, text_col, 1).alias("row2")]


def boxed(docs: DataFrame) -> DataFrame:
    """All columns of `docs` in one struct, `box`, so that no name clashes with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("box"))


def unboxed(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of the box again, some of them replaced."""
    return df.select(*[replaced.get(c, F.col("box").getField(c)).alias(c) for c in columns])
