"""Documents to packed training sequences: STAGES in order, each over all that its predecessor kept.

Every stage but the last returns the columns of documents: the quality classifier drops what it
rejects, the n-gram Jaccard join leaves one document of each group of near copies, mixing gives the
pieces of documents that its schedule takes, in the order of the schedule, so that sources reach their
target weights, and packing lays the words of all that remain into bins.

Defined results: null, empty and blank texts are scored like others, are no copies of each other and
have no words to mix; rows with a null doc_id stay as they are scored; of rows that repeat a doc_id
one stays; without labels every document scores 1/2 and is kept; extra columns are kept up to the
last stage, whatever their names; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import common, jaccard, mixing, packing, q_quality, quality


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, q_quality.forest(docs, spark, sf_dir))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("n-gram jaccard join", deduplicate), ("mixing", mix), ("best-fit packing", pack)]

#: A trained classifier can't be written as SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of ``documents`` after all stages, each stage's result being written and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.table(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
