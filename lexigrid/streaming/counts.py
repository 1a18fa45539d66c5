"""Running n-gram counts of a stream of documents.

Windows never leave their row, so the batch expressions work on a stream as they are; the counts
are the state, one row a distinct n-gram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import windows as W


def running_counts(docs: DataFrame, n: int, *, text: str = "text", pos: bool = False) -> DataFrame:
    """w0.., frequency of a streaming ``docs``; write it in update or complete mode."""
    return W.table(W.text_words(docs, text, pos), n)
