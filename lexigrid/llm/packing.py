"""Best-fit packing into bins of several permitted sequence lengths.

Items are taken from the longest to the shortest. An item goes into the open bin that it
leaves the least room in. Where none has room, a new bin is opened of the permitted length
whose cost per filled token is least, the filling being looked ahead greedily over the lengths
that still wait; ``cost(c) = c * (1 + c / long_cost)``, so that a long bin must fill better than
a short one to be preferred. At the end each bin is cut down to the shortest permitted length
that holds its contents.

A text has its words and one end mark as tokens, so an empty or null text has length 1 and is
packed too. Texts longer than the longest bin are cut: full pieces are bins of their own and
never reach Python; only the rest is packed. The items are dealt to tasks of about
``group_rows`` each by a round robin, whatever their keys, so repeated rows or a hot source
can't make a large task; only (doc_id, piece, length) gets there. An empty table gives an
empty result; other columns are ignored; repeated rows are packed once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITIES = (256, 512, 1024, 2048, 4096)
SCHEMA = "doc_id string, piece long, start long, length long, bin_id long, capacity long, bin_start long"


def plan(lengths: list[int], capacities=CAPACITIES, long_cost: float = 65536.0) -> tuple[list[int], list[int]]:
    """For ``lengths`` in falling order: the bin of each, and each bin's final capacity."""
    sizes = sorted(capacities)
    top = sizes[-1]
    left = [0] * (top + 1)  # how many items of a length wait
    for n in lengths:
        left[n] += 1
    below = list(range(top + 1))  # below[n]: a length <= n, on the way to the largest that waits

    def longest(n: int) -> int:
        root = n
        while root and (below[root] != root or not left[root]):
            if below[root] == root:
                below[root] = root - 1
            root = below[root]
        while n != root:
            below[n], n = root, below[n]
        return root

    def fill(room: int) -> int:
        """Tokens of those waiting that fit greedily, longest first."""
        got, n = 0, room
        while room and (n := longest(min(n, room))):
            k = min(left[n], room // n)
            got, room, n = got + k * n, room - k * n, n - 1
        return got

    rooms: dict[int, list[int]] = {}  # room -> open bins with it
    mask = 0  # bit r: some open bin has room r
    bins: list[int] = []  # room of each bin
    filled: list[int] = []
    where: list[int] = []
    for n in lengths:
        left[n] -= 1
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            best, room = math.inf, 0
            for c in sizes:
                if c >= n:
                    cost = c * (1 + c / long_cost) / (n + fill(c - n))
                    if cost <= best:
                        best, room = cost, c
            b = len(bins)
            bins.append(room)
            filled.append(0)
        bins[b] = room - n
        filled[b] += n
        where.append(b)
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return where, [next(c for c in sizes if c >= f) for f in filled]


def _packer(capacities, long_cost: float):
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [p for p in parts if len(p)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True).sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="last", ignore_index=True)
        where, final = plan(rows["length"].tolist(), capacities, long_cost)
        rows["bin_start"] = rows.groupby(pd.Series(where))["length"].cumsum() - rows["length"]
        rows["capacity"] = [final[b] for b in where]
        rows["bin_id"] = [TaskContext.get().partitionId() << 32 | b for b in where]
        yield rows

    return pack


def pack(docs: DataFrame, **options) -> DataFrame:
    """``place`` for the texts of ``docs`` (doc_id, text), words and an end mark being the tokens."""
    folder = common.shared_dir(docs.sparkSession, "packing")
    return place(common.table(docs.select("doc_id", (common.n_words(F.col("text")) + 1).alias("n")), folder, "sized"), **options)


def place(sized: DataFrame, *, capacities=CAPACITIES, long_cost: float = 65536.0, group_rows: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, bin_start for every piece of every row of a stored
    table (doc_id, n): tokens start..start+length of the document lie at bin_start in
    the bin. Bins of whole pieces have negative ids; a row without tokens has no piece."""
    top = max(capacities)
    groups = max(1, math.ceil(sized.count() / group_rows))
    whole = (
        sized.where(F.col("n") >= top)
        .select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / top) - 1)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.lit(top).cast("long").alias("length"), (-1 - F.monotonically_increasing_id()).alias("bin_id"), F.lit(top).cast("long").alias("capacity"), F.lit(0).cast("long").alias("bin_start"))
    )
    rest = (
        sized.withColumn("piece", F.floor(F.col("n") / top)).withColumn("start", F.col("piece") * top)
        # as a string, a null id costs the others no precision in pandas
        .select(F.col("doc_id").cast("string"), "piece", "start", (F.col("n") - F.col("start")).alias("length")).where("length > 0")
    )
    parts = rest.repartition(groups).mapInPandas(_packer(tuple(capacities), long_cost), SCHEMA)
    return whole.unionByName(parts.withColumn("doc_id", F.col("doc_id").cast("long")))


def pack_tokens(tokens: DataFrame, *, pad_id: int = 0, **options) -> DataFrame:
    """Packed sequences of ``tokens`` (doc_id, ids), such as the id store gives back: a row a bin with

    bin_id, capacity, tokens (filled up with ``pad_id``); positions, which begin at 0 in each piece; segments,
    1 for the first piece, 2 for the next, 0 for the filling, so attention can stop at document boundaries;
    doc_ids and starts (in the document) of the pieces. Null ids are none; repeated rows are packed
    once each. A bin is gathered in one row, which its capacity bounds."""
    folder = common.shared_dir(tokens.sparkSession, "packing")
    rows = common.table(tokens.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), folder, "tokens")
    placed = place(rows.select(F.col("rid").alias("doc_id"), F.size("ids").cast("long").alias("n")), **options).withColumnRenamed("doc_id", "rid")
    pieces = placed.join(rows, "rid").select("bin_id", "capacity", F.struct("bin_start", "doc_id", "start", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("p"))
    bins = pieces.groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list("p")).alias("p"))
    used = F.size(F.flatten("p.ids"))
    filled = lambda x, by: F.concat(x, F.array_repeat(F.lit(by), (F.col("capacity") - used).cast("int")))
    return bins.select(
        "bin_id", "capacity", filled(F.flatten("p.ids"), pad_id).alias("tokens"),
        filled(F.flatten(F.transform("p", lambda p: F.sequence(F.lit(0), F.size(p["ids"]) - 1))), 0).alias("positions"),
        filled(F.flatten(F.transform("p", lambda p, k: F.array_repeat(k + 1, F.size(p["ids"])))), 0).alias("segments"),
        F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"),
    )
