"""What the training-data operators share: words, shared folders and distributed running totals."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters that end a word; the first is the one that words are split on.
SPACES = " \t\n\x0b\x0c\r"

_own: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which every executor can reach.

    Where a local session has no such setting (tests) a temporary folder of this process is used and
    removed at its end; on a cluster, whose machines would each see their own, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="lexigrid-"))
        base = "file://" + _own[0].name
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into ``folder`` and reads it again: it cuts the lineage and
    survives the loss of any executor."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def drop(folder: str, *names: str) -> None:
    """Removes tables that nothing reads again."""
    fs, base = FileSystem.from_uri(folder)
    for name in names:
        if fs.get_file_info(f"{base}/{name}").type == FileType.Directory:
            fs.delete_dir(f"{base}/{name}")


def words(text: Column, lower: bool = False) -> Column:
    """The maximal runs of characters other than SPACES, in order; null for a null text.
    ``lower`` also maps A-Z (and nothing else) to a-z."""
    plain = F.translate(text, (UPPER if lower else "") + SPACES[1:], (LOWER if lower else "") + " " * 5)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words() a text has, 0 for null, as long."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before a row, per ``keys``, in the order
    of ``bucket`` and within it of ``order``. ``bucket`` must follow the order.

    No task sees a whole key: rows are summed per (keys, bucket) with map-side partial sums,
    only those sums are accumulated per key, and the rest runs inside single buckets. So a key
    that holds a third of all rows is spread over as many tasks as it has buckets.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0).cast("long"))).drop("_sum")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0).cast("long")))
    return both.join(before, [*keys, bucket]).withColumn(out, F.col("_before") + F.col("_inner")).drop("_before", "_inner")
