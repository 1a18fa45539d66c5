"""Query op8_idstore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, idstore


def op8_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.shared_dir(spark, "idstore")
    idstore.write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return idstore.read(spark, folder, with_ids=False).drop("ids")


QUERIES, ORACLES = {"op8_idstore": op8_idstore}, {}
