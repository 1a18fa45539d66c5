"""Text files in chunks, generated text, and tables of n-grams as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import columns, permuted, size_of

#: 2**CHUNK_BITS lines make a chunk.
CHUNK_BITS = 10


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """file, chunk, text: text files of any size, in chunks of lines that sort in the order of the file.

    Files are split between lines by the scan, so no task reads a whole large one. Windows run
    over chunks (``windows.chunk_windows``). Bytes that aren't UTF-8 are no letters and vanish."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    chunk = F.struct("at", F.shiftright("id", CHUNK_BITS).alias("part"))
    each = lines.groupBy("file", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("lines"))
    return each.select("file", "chunk", F.concat_ws("\n", "lines.value").alias("text"))


def generated(spark: SparkSession, documents: int, *, words: int = 200, vocabulary: int = 10_000, seed: int = 0) -> DataFrame:
    """doc_id, text: test documents of ``words`` words whose k-th most frequent word is about 1/k as frequent as the first."""
    letter = lambda rank, k: F.char(F.lit(97) + F.pmod(F.shiftright(F.xxhash64(rank, F.lit(k)), 7), F.lit(26)))
    rank = lambda i: F.floor(F.pow(F.lit(float(vocabulary)), F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)))
    ranks = F.transform(F.sequence(F.lit(1), F.lit(words)), rank)
    spell = lambda r: F.concat(*[letter(r, k) for k in range(4)], F.when(r > 100, F.concat(letter(r, 4), letter(r, 5))).otherwise(""))
    return spark.range(documents).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(ranks, spell)).alias("text"))


def write_index(grams: DataFrame, order: tuple[int, ...], path: str) -> None:
    """The index by ``order`` as text: words and count parted by tabs, lines in order over all files."""
    words = [f"w{k}" for k in order]
    rows = permuted(grams, order).orderBy(*words)
    rows.select(F.concat_ws("\t", *words, F.col("frequency").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str, order: tuple[int, ...]) -> DataFrame:
    """Rows that write_index wrote, columns back in the order of the text."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).select(*[F.get(cells, F.lit(order.index(k))).alias(f"w{k}") for k in range(len(order))], F.get(cells, F.lit(len(order))).cast("long").alias("frequency"))
    return rows.select(*columns(size_of(rows)), "frequency")
