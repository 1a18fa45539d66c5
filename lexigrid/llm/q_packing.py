"""Query op2_packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import packing


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES, ORACLES = {"op2_packing": op2_packing}, {}
