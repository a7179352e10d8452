"""From raw documents to a training mix: five stages, each on all that the one before kept.

Quality and near-duplicate stages drop documents, decontamination drops documents that hold a benchmark window, the secret
scan blacks out what it finds and keeps the document, and the last stage draws the mix: one row for each document that it
takes, with the number of copies. Each stage but the last returns the columns of documents. A classifier is one of the
stages, so no SQL gives the rows; the tests hold the pipeline against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtable.llm import decontaminate, mixing, quality, secrets, simhash
from speechtable.llm.common import table, written
from speechtable.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs.select(*COLUMNS), table(ship(spark), sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    ship(spark)
    return simhash.dedup(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.remove(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blacked out."""
    return secrets.redact(docs.select(*COLUMNS))


def draw_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, taken (words) and copies."""
    mixed = mixing.mix(docs.select(*COLUMNS)).filter("taken > 0")
    return mixed.withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("source_mixing", draw_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
