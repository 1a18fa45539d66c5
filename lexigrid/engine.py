"""The library's front: tables of n-grams of one corpus, their queries, and their storage."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EDGE
from .functions import permutations
from .operators import queries as Q
from .operators import windows as W
from .sources import corpus


class NgramTable:
    """All windows of n words of a corpus with their frequencies, and what can be asked of them."""

    def __init__(self, grams: DataFrame, pos: bool = False):
        self.grams, self.n, self.pos = grams, W.size_of(grams), pos

    def numwords(self) -> int:
        return self.grams.where(F.col("w0") != EDGE).agg(F.sum("frequency")).first()[0] or 0

    def index(self, order: tuple[int, ...]) -> DataFrame:
        """By ``order``: sorted rows of windows with a word at its first position."""
        return W.permuted(self.grams, order).orderBy(*[f"w{k}" for k in order])

    def orders(self, first: int = 0, howmany: int | None = None) -> Iterator[tuple[int, ...]]:
        """The search family, or ``howmany`` of it from the ``first`` on."""
        return islice(permutations.orders(self.n), first, None if howmany is None else first + howmany)

    def indexes(self, first: int = 0, howmany: int | None = None) -> dict[tuple[int, ...], DataFrame]:
        return {order: self.index(order) for order in self.orders(first, howmany)}

    def search(self, pattern: str) -> DataFrame:
        return Q.ranked(Q.search(self.grams, pattern, self.pos))

    def search_regrouped(self, pattern: str) -> DataFrame:
        return Q.ranked(Q.regrouped(Q.search(self.grams, pattern, pos=True), pattern))

    def entropy_of(self, pattern: str) -> float:
        """Of the words that the pattern's wildcards stand for; a pattern that finds nothing is an error."""
        found = Q.entropy_of(Q.search(self.grams, pattern, self.pos)).first()[0]
        if found is None:
            raise ValueError(f"nothing matches {pattern!r}")
        return found

    def get_top(self, m: int) -> DataFrame:
        return Q.top(self.grams, m)

    def inverted(self, order: tuple[int, ...]) -> DataFrame:
        return Q.inverted(self.grams, order)

    def entropy_index(self, pattern: str) -> DataFrame:
        return Q.entropy_index(self.grams, pattern)

    def entropy_top(self, pattern: str, k: int, min_frequency: int = 1) -> DataFrame:
        return Q.entropy_top(self.grams, pattern, k, min_frequency)

    def entropy_stats(self, pattern: str) -> DataFrame:
        return Q.entropy_stats(self.grams, pattern).orderBy("entropy")

    def wordlength_stats(self) -> DataFrame:
        if self.pos:
            raise ValueError("length statistics are for plain tables")
        return Q.lengths(self.grams).orderBy("length")

    def merge(self, other: NgramTable) -> NgramTable:
        if (self.n, self.pos) != (other.n, other.pos):
            raise ValueError("tables of different kinds can't be merged")
        return NgramTable(W.merge(self.grams, other.grams), self.pos)

    def save(self, path: str) -> None:
        """As Parquet, range-partitioned and sorted by words, so that a search for a first word reads few row groups."""
        words = W.columns(self.n)
        self.grams.repartitionByRange(*words).sortWithinPartitions(*words).write.mode("overwrite").parquet(path)

    def save_index(self, path: str, order: tuple[int, ...], ranged: bool = False) -> None:
        """The index by ``order``, stored likewise by its own columns; ``ranged``: the rows lie in ranges of them already."""
        words = [f"w{k}" for k in order]
        rows = W.permuted(self.grams, order)
        (rows if ranged else rows.repartitionByRange(*words)).sortWithinPartitions(*words).write.mode("overwrite").parquet(path)


class NgramEngine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def from_text(self, docs: DataFrame, n: int, *, text: str = "text", pos: bool = False) -> NgramTable:
        """Of ``docs`` (doc_id, text); with ``pos``, texts are lines "word type lemma"."""
        if n < 1:
            raise ValueError("n must be at least 1")
        return NgramTable(W.table(W.text_words(docs, text, pos), n), pos)

    def from_files(self, path: str, n: int, *, pos: bool = False) -> NgramTable:
        """Of text files of any size; with ``pos``, of lines "word type lemma"."""
        if n < 1:
            raise ValueError("n must be at least 1")
        return NgramTable(W.count(W.chunk_windows(W.text_words(corpus.read_text(self.spark, path), pos=pos), n)), pos)

    def all_up_to(self, table: NgramTable) -> dict[int, NgramTable]:
        """Tables of 1..n from that of n, whose text is cleaned and counted once: counts of shorter
        windows add up from those of the longer ones."""
        return {n: NgramTable(W.shorten(table.grams, n), table.pos) for n in range(1, table.n)} | {table.n: table}

    def vocabulary(self, docs: DataFrame, *, text: str = "text") -> DataFrame:
        """Distinct part-of-speech words with their frequencies."""
        return W.vocabulary(W.text_words(docs, text, pos=True))

    def load(self, path: str, pos: bool = False) -> NgramTable:
        return NgramTable(self.spark.read.parquet(path), pos)
