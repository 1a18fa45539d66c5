"""Query op7_media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import media


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES, ORACLES = {"op7_media": op7_media}, {}
