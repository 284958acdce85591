"""Training-data pipeline over the documents table: each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, mixing, pii, quality_rules
from tidemark.llm.workspace import Workspace, boxed, row_number, unboxed

#: Some stages (learned posteriors, merges of a vocabulary) have no SQL form; tests hold each against brute force.
ORACLE_SQL = None


def keep_by_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; null and empty texts go, repeated rows stay or go together."""
    return quality_rules.kept_rows(docs)


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of every component of near copies (five-word shingles, Jaccard of 0.8).

    Rows without an id are kept as others are, after those with one; of rows equal in
    id and text one is kept.  Rows without words are their own groups.
    """
    work = Workspace(spark, "firsts")
    groups = jaccard_join.jaccard_components(docs, rows=True)
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    linked = groups.where("root is not null").groupBy("root").agg(F.min(least).alias("x")).select("x.row")
    firsts = work.keep(linked.unionByName(groups.where("root is null").select("row")).distinct(), "firsts")
    again = work.keep(groups.groupBy("row").count().where("count > 1").select("row"), "again")
    box = F.col("box")
    kept = boxed(docs).select("box", row_number(box["doc_id"], box["text"]).alias("row")).join(firsts, "row", "left_semi")
    once = kept.join(again, "row", "left_anti").unionByName(kept.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return unboxed(once, docs.columns)


def mask_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text and stays null where the text is null."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_to_targets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by their rates, which are at least one here: mixing adds weight and drops no document, null texts and ids included."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mixing.mixed(docs, mixing.labelled_domains(docs, labels), least=1.0, budget=1.2, keys=True)
    return mixing.copies(docs, Workspace(spark, "rates").keep(rates, "rates"))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and digests of ids and decoded text; a null text has no tokens, repeated rows come one by one."""
    return bpe.encoded(docs, bpe.vocabulary_path(), digests=True)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("ngram_jaccard_join", one_of_each_group),
    ("pii", mask_personal_data),
    ("mixing", mix_to_targets),
    ("bpe", encode),
]


def run(spark, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, writing and rereading each result."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
