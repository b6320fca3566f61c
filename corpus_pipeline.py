"""A training-data pipeline over ``documents``: five stages, each written and read again.

In every stage a null text counts as empty, a null id is no reason to lose a row, ties
and repeated rows are decided row by row as each docstring says, texts are read whole
whatever their length, further columns of the input are ignored, and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.functions.cluster import materialize, scratch_path
from riskgraph.llm import cotraining, minhash, packing, quality_rules, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failing lines.

    Null and empty texts are rejected; of equal lines of a text the first stays; a text
    that loses no line stays as it is, and ``n_chars`` is counted anew only where one
    went. Repeated rows are judged one by one and all stay or go.
    """
    return quality_rules.keep_documents(docs.select(*COLUMNS))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    Null texts, languages, sources and lengths are features of their own; rows without
    an id are judged but not trained on; repeated rows are judged one by one. If the
    labels lack a class, all documents stay.
    """
    return cotraining.keep_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the smallest doc_id.

    Rows are told apart by a key of their own, as ids may be null or repeat: rows with
    a null id all stay, rows that repeat an id are decided each by its text, and rows
    without a word are one if they share their id.
    """
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumn("blank", ~F.coalesce("text", F.lit("")).rlike(r"(?U)\S")))
    known = rows.where("doc_id is not null")
    found = minhash.near_duplicates(known, "row").select(F.col("doc_id").alias("row"), "class_id")
    found = found.join(known.select("row", "doc_id", "blank"), "row")
    by = [F.when(~F.col("blank"), F.col("class_id")).alias("c"), F.when(F.col("blank"), F.col("doc_id")).alias("i")]
    first = found.groupBy(*by).agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    keep = first.unionByName(rows.where("doc_id is null").select("row"))
    return rows.join(keep, "row", "left_semi").select(*COLUMNS)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask and lengths counted anew where one was.

    Null texts stay null; repeated rows are masked one by one, whatever their ids.
    """
    return secrets.mask_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens.

    A null or empty text is one end token; repeated rows are packed one by one, null
    ids pass through; pieces of equal length are placed in the order of their tasks.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_dedup", minhash_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]
#: Training, signatures and tokenizers are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
