"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors become integers, floor(scale * x). Candidates are cut into ranges of ids, ranges into
blocks of ``BLOCK`` vectors; a block keeps its forward index (its vectors) and, for each term (a
component), the largest and smallest value. For a query the sum of its terms' largest possible
products bounds every score in a block. Each query takes the blocks from the highest bound down
and stops when a bound falls below its k-th best score so far; a bound equal to it is still
scored, since ties go to the smaller id. So nothing is lost and no vector is scored outside a block
that could matter. Inside a range blocks hold vectors that are alike (``similar``), which makes their
bounds tight where vectors cluster; vectors spread evenly in all directions leave nothing to prune.

Queries meet candidates in a grid of id ranges x groups of queries; a task holds one range and one
group (at most RANGE_ROWS and GROUP_ROWS vectors), keeps k rows a query, and these are merged per
query by a window over k rows a range.

Defined results: vectors that are null, or hold a null, NaN or infinite component, and rows with a
null id take no part; vectors of different lengths count missing components as 0; a row with the
query's id is the query's own; a query row that repeats id and vector is answered once; ties in
score rank by id, and repeated candidate rows are candidates each. Integer scores are exact within
64 bits. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, RANGE_ROWS, GROUP_ROWS = 128, 65536, 16384
FOUND = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "query_id long, query long, vec_id long, score long"


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``width`` integers, filled up with 0."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(flat.offsets.to_numpy()) if len(flat) else np.zeros(0, int)
    values = flat.flatten().to_numpy()
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def similar(vectors: np.ndarray) -> np.ndarray:
    """An order in which neighbours are alike: by the signs along the directions of most variance."""
    c = vectors - vectors.mean(axis=0)
    _, axes = np.linalg.eigh(c.T @ c)
    signs = c @ axes[:, ::-1][:, :12] > 0
    return np.argsort(signs @ (1 << np.arange(signs.shape[1])[::-1]), kind="stable")


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """For every query its k best candidates other than itself: their places (-1: none) and scores,
    by falling score and rising id; and how many blocks were scored. ``ids`` must be sorted."""
    n, width = vectors.shape
    # products of integers are exact in doubles below 2**53
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    if most < 2**53:
        vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
    low = np.iinfo(np.int64).min
    top = np.full((len(queries), k), low, np.int64)
    place = np.full((len(queries), k), -1, np.int64)
    if not n or not len(queries):
        return place, top, 0
    at = similar(vectors.astype(np.float64))
    vectors, ids = vectors[at], ids[at]  # places stay those of the sorted ids
    starts = np.arange(0, n, block)
    largest, smallest = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    bounds = (np.maximum(queries, 0) @ largest.T + np.minimum(queries, 0) @ smallest.T).astype(np.int64)
    order = np.argsort(-bounds, axis=1, kind="stable")
    scored, live = 0, np.arange(len(queries))
    for step in range(len(starts)):
        live = live[bounds[live, order[live, step]] >= top[live, -1]]  # bounds only fall from here on
        if not len(live):
            break
        blocks = order[live, step]
        by = np.argsort(blocks, kind="stable")
        for group in np.split(live[by], np.flatnonzero(np.diff(blocks[by])) + 1):
            b = order[group[0], step]
            first, last = starts[b], min(starts[b] + block, n)
            got = (queries[group] @ vectors[first:last].T).astype(np.int64)
            got[query_ids[group][:, None] == ids[first:last]] = low
            scored += len(group)
            scores = np.concatenate([top[group], got], axis=1)
            places = np.concatenate([place[group], np.broadcast_to(at[first:last], got.shape)], axis=1)
            best = np.lexsort((places, -scores.astype(np.float64) if most < 2**53 else ~scores), axis=1)[:, :k]  # places follow ids
            top[group], place[group] = np.take_along_axis(scores, best, 1), np.take_along_axis(places, best, 1)
    place[top == low] = -1
    return place, top, scored


def _searcher(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        candidates = candidates.sort_by("vec_id")
        width = max(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in (candidates, queries) for c in t["v"].chunks)
        ids, asked = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        place, score, _ = search(ids, matrix(candidates["v"], width), asked, matrix(queries["v"], width), k)
        q, r = np.nonzero(place >= 0)
        return pa.table([pa.array(asked[q]), pa.array(queries["query"].to_numpy()[q]), pa.array(ids[place[q, r]]), pa.array(score[q, r])], schema=FOUND)

    return run


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where a vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def topk(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` (vec_id, embedding) for each row of them that ``is_query`` holds for."""
    spark = vectors.sparkSession
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    ready = common.table(ready.where("vec_id IS NOT NULL AND v IS NOT NULL"), common.shared_dir(spark, "topk"), "vectors")
    n, asked = ready.agg(F.count("*"), F.count_if("asks")).first()
    ranges = max(math.ceil(n / RANGE_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / 2048)), 1)
    groups = max(math.ceil(asked / GROUP_ROWS), 1)
    # ranges of ids; rows of one id may be parted, so none makes a large task
    left = ready.repartitionByRange(ranges, "vec_id", "row").select("vec_id", "v", F.spark_partition_id().alias("range"))
    left = left.select("vec_id", "v", "range", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    query = F.xxhash64("vec_id", "v")
    right = ready.where("asks").select("vec_id", "v", query.alias("query")).distinct()
    right = right.select("vec_id", "v", "query", F.pmod("query", F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"))
    found = left.groupBy("range", "group").cogroup(right.groupBy("range", "group")).applyInArrow(_searcher(k), FOUND_SQL)
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
