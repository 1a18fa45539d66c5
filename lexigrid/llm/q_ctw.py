"""Query op1_ctw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ctw.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


QUERIES, ORACLES = {"op1_ctw": op1_ctw}, {}
