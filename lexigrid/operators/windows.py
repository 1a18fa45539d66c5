"""Windows of n words over segments, and their counts.

A table of n-grams has the columns w0..w{n-1} and frequency: all windows that hold at least one
word of a segment, EDGE standing for places before and after it. Windows are made inside each
row with array functions, so counting them is the only shuffle, after a map-side count.

Defined results: rows that repeat a doc_id are documents each; a null or empty text has no words and
no windows; columns other than those named are ignored, whatever they are called; an empty table
gives an empty result; a text of any length is one row, files may come in chunks (``chunk_windows``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EDGE
from ..functions import text as T


def columns(n: int) -> list[str]:
    return [f"w{k}" for k in range(n)]


def size_of(grams: DataFrame) -> int:
    """n of a table of n-grams."""
    return sum(c[0] == "w" and c[1:].isdigit() for c in grams.columns)


def any_word(n: int) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) != EDGE for c in columns(n)])


def text_words(docs: DataFrame, text: str = "text", pos: bool = False) -> DataFrame:
    """One row per document with its array ``words``; with ``pos``, texts are lines "word type lemma"."""
    found = T.pos_text(F.col(text)) if pos else T.words(F.col(text))
    return _held(docs, found)


def line_words(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """The same for arrays of part-of-speech lines."""
    return _held(docs, T.pos_words(F.col(lines)))


def _held(docs: DataFrame, words: Column) -> DataFrame:
    # Through a generator, so that no later filter is pushed below and computes the words again.
    keep = [c for c in docs.columns if c in ("doc_id", "lang", "file", "chunk")]
    return docs.select(*keep, F.explode_outer(F.array(words)).alias("words"))


def _laid(n: int) -> Column:
    """The ``words`` with n - 1 edges for each null word."""
    parted = F.flatten(F.transform("words", lambda w: F.when(w.isNull(), F.array_repeat(F.lit(EDGE), n - 1)).otherwise(F.array(w))))
    return F.when(F.exists("words", lambda w: w.isNull()), parted).otherwise(F.col("words"))


def _inside(laid: DataFrame, n: int) -> DataFrame:
    """One row per window of the arrays ``a``, whose starts are exploded: this is compiled, a lambda that makes
    windows isn't."""
    starts = F.when(F.size("a") >= n, F.sequence(F.lit(0), F.size("a") - n))
    each = laid.select("a", F.explode(starts).alias("i"))
    return each.select(*[F.get("a", F.col("i") + k).alias(c) for k, c in enumerate(columns(n))]).where(any_word(n))


def windows(held: DataFrame, n: int) -> DataFrame:
    """One row w0..w{n-1} per window of the ``words`` arrays; a null or empty array has none."""
    edges = F.array_repeat(F.lit(EDGE), n - 1)
    return _inside(held.where(F.size("words") > 0).select(F.explode_outer(F.array(F.concat(edges, _laid(n), edges))).alias("a")), n)


def chunk_windows(held: DataFrame, n: int) -> DataFrame:
    """The same for files that come in chunks (file, chunk, words): segments run on from a chunk to the next.

    A chunk makes the windows that begin in it, and for the last n - 1 of these is lent the first
    words of the chunks behind it. Only those heads, n - 1 words a chunk, are gathered by file."""
    edges = F.array_repeat(F.lit(EDGE), n - 1)
    laid = held.select("file", "chunk", F.explode_outer(F.array(_laid(n))).alias("a")).where(F.size("a") > 0)
    order = Window.partitionBy("file").orderBy("chunk")
    lent = F.concat(*[F.coalesce(F.lead("head", k).over(order), edges) for k in range(1, n)], edges) if n > 1 else edges
    heads = laid.select("file", "chunk", F.slice("a", 1, max(n - 1, 1)).alias("head"))
    heads = heads.select("file", "chunk", F.slice(lent, 1, max(n - 1, 1)).alias("behind") if n > 1 else edges.alias("behind"), (F.row_number().over(order) == 1).alias("first"))
    whole = laid.join(heads, ["file", "chunk"]).select(F.concat(F.when(F.col("first"), edges).otherwise(F.array().cast("array<string>")), "a", "behind").alias("a"))
    return _inside(whole.select(F.explode_outer(F.array("a")).alias("a")), n)


def count(made: DataFrame) -> DataFrame:
    words = columns(len(made.columns))
    return made.groupBy(*words).agg(F.count("*").alias("frequency"))


def table(held: DataFrame, n: int) -> DataFrame:
    """The table of n-grams of ``words`` arrays."""
    return count(windows(held, n))


def merge(*tables: DataFrame) -> DataFrame:
    """Counts of several corpora together."""
    words = columns(size_of(tables[0]))
    every = reduce(lambda a, b: a.unionByName(b), [t.select(*words, "frequency") for t in tables])
    return every.groupBy(*words).agg(F.sum("frequency").alias("frequency"))


def shorten(grams: DataFrame, n: int) -> DataFrame:
    """n-gram counts from those of longer windows: every n-gram begins one longer window, so counts
    of the first n columns add up."""
    words = columns(n)
    return grams.where(any_word(n)).groupBy(*words).agg(F.sum("frequency").alias("frequency"))


def permuted(grams: DataFrame, order: tuple[int, ...]) -> DataFrame:
    """The index of ``grams`` by ``order``: windows with a word at its first position, columns in order."""
    if sorted(order) != list(range(size_of(grams))):
        raise ValueError(f"{order} is no order of {size_of(grams)} columns")
    words = [f"w{k}" for k in order]
    return grams.where(F.col(words[0]) != EDGE).select(*words, "frequency")


def token_stats(held: DataFrame, by: str) -> DataFrame:
    """``by``, words, null_words, segments: sums over documents. Neighbouring null words count as one break."""
    all_ = F.col("words")
    firsts = F.filter(F.transform(all_, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isNotNull() & ((x["i"] == 0) | F.get(all_, x["i"] - 1).isNull()))
    each = held.select(by, F.size(all_).alias("_all"), F.size(F.filter(all_, lambda w: w.isNotNull())).alias("_real"), F.size(firsts).alias("_segments"))
    return each.groupBy(by).agg(F.sum("_real").alias("words"), F.sum(F.col("_all") - F.col("_real")).alias("null_words"), F.sum("_segments").alias("segments"))


def vocabulary(held: DataFrame) -> DataFrame:
    """classification, lemma, inflexion, frequency of part-of-speech words."""
    word = held.select(F.explode("words").alias("w")).where(F.col("w").isNotNull())
    part = [F.split_part("w", F.lit("|"), F.lit(k + 1)).alias(c) for k, c in enumerate(("classification", "lemma", "inflexion"))]
    return word.select(*part).groupBy("classification", "lemma", "inflexion").agg(F.count("*").alias("frequency"))


def vocabulary_of(grams: DataFrame) -> DataFrame:
    """The same from a part-of-speech table of n-grams: every word begins one window."""
    part = [F.split_part("w0", F.lit("|"), F.lit(k + 1)).alias(c) for k, c in enumerate(("classification", "lemma", "inflexion"))]
    return shorten(grams, 1).select(*part, "frequency")


def placed(rows: DataFrame, order: list, folder: str) -> DataFrame:
    """``rows`` with their ``place``, from 1, in ``order``: sorted by ranges into ``folder``, each range's rows
    then counted on from the ranges before it. No task sees all rows."""
    rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/sorted")
    held = rows.sparkSession.read.parquet(f"{folder}/sorted").withColumn("_part", F.shiftright("_id", 33))
    before = held.groupBy("_part").agg(F.count("*").alias("n"))
    before = before.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    return held.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_id", "_before")


def unsorted_rows(grams: DataFrame, words: list[str]) -> DataFrame:
    """violations: how many rows of ``grams`` (with a column ``row`` that numbers them, with gaps or without)
    don't lie strictly above the row before. Rows are compared within ranges of 2**16 numbers, and
    each range's first with the last of the range before it, so no task sorts the whole table."""
    ranged = grams.select("row", F.struct(*words).alias("k")).withColumn("_range", F.floor(F.col("row") / 65536))
    inside = ranged.select((F.lag("k").over(Window.partitionBy("_range").orderBy("row")) >= F.col("k")).alias("bad"))
    ends = ranged.groupBy("_range").agg(F.min_by("k", "row").alias("first"), F.max_by("k", "row").alias("last"))
    across = ends.select((F.lag("last").over(Window.orderBy("_range")) >= F.col("first")).alias("bad"))
    return inside.unionByName(across).agg(F.count_if("bad").alias("violations"))
