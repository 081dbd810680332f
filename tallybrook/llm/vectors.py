"""What both vector searches share: usable rows, and the grid of row blocks and query blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id and a non-empty vector of finite components, as doubles' or floats' array."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return frame.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def dimension(rows: DataFrame) -> int:
    """The most common length of the vectors (the smaller of equally common ones), 0 without rows."""
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first.d if first else 0


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """List column of equal lengths as a matrix of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(whole), d)


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in id order, one per id: of several vectors under one id the smallest, component by component."""
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*x.T[::-1], ids))
        order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
    return ids[order], x[order]


def top_by_blocks(rows: DataFrame, every: int, k: int, d: int, search: Callable, score_type: str, *, block_rows: int, block_queries: int, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query (ids divisible by ``every``) over all rows.

    Rows are dealt into blocks by a hash of the id, queries likewise, and each pair of blocks is one bounded group;
    ``search(ids, x, query_ids, q)`` gives arrays (query_id, vec_id, score) with at most ``k`` rows a query.
    Only those meet in the final ranking. ``asked`` (id, v) are the queries, if not all.
    """
    n = rows.count()
    if asked is None:
        asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    parts, rounds = max(1, -(-n // block_rows)), max(1, -(-(asked.count()) // block_queries))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("qb"), "id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("rb"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)).cast("int").alias("qb"), "id", "v")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            ids, x = distinct_rows(a.column("id").to_numpy(), matrix(a.column("v"), d))
            queries, q = distinct_rows(b.column("id").to_numpy(), matrix(b.column("v"), d))
            got = search(ids, x, queries, q)
        else:
            got = ([], [], [])
        return pa.table([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64() if score_type == "long" else pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(cell, f"query_id long, vec_id long, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
