"""The family of column orders that answers every wildcard search by a prefix: for each subset of
known positions, some order begins with exactly those positions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def orders(n: int) -> Iterator[tuple[int, ...]]:
    """C(n, n // 2) orders of 0..n-1, from balanced bit strings: a one opens a position, a zero closes
    the last open one. Closed positions, then positions closed by it, then those still open."""
    ones = [True] * n
    while True:
        first: list[int] = []
        opened: list[int] = []
        closed: list[int] = []
        for place, one in enumerate(ones):
            if one:
                opened.append(place)
            else:
                first.append(place)
                closed.append(opened.pop())
        yield (*sorted(first), *sorted(opened), *sorted(closed))
        if (following := _following(ones)) is None:
            return
        ones = following


def _following(ones: list[bool]) -> list[bool] | None:
    """The next string in which no prefix has more zeros than ones, in falling order."""
    for at in range(len(ones) - 1, -1, -1):
        if ones[at] and (head := [*ones[:at], False]).count(False) * 2 <= len(head):
            return head + [True] * (len(ones) - len(head))
    return None


def anchor(known: list[int], n: int) -> int:
    """The first column of the least order whose first entries are just the ``known`` positions."""
    for order in sorted(orders(n)):
        if set(order[: len(known)]) == set(known):
            return order[0]
    raise ValueError(f"no order of {n} columns begins with {known}")


def table(spark: SparkSession, most: int) -> DataFrame:
    """n, ordinal, permutation for n = 1..most."""
    rows = [(n, k, "_".join(map(str, o))) for n in range(1, most + 1) for k, o in enumerate(orders(n))]
    return spark.createDataFrame(rows, "n int, ordinal int, permutation string")
