"""Vectors that take part in a search, and the grid of query and candidate blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

QUERIES_PER_CELL = 2_048
ROWS_PER_CELL = 4_096


def searchable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", zero: bool = True) -> DataFrame:
    """(vec_id, vec, place): every row that can be compared, with a number of its own, as a checkpoint.

    Null ids, vectors that are null, empty or hold null or non-finite
    components, and (unless ``zero``) zero vectors take no part.  Rows that share an id all take part.
    """
    vec = F.col(vector)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = rows.where(F.col(vec_id).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ~bad)
    if not zero:
        fit = fit.where(F.exists(vec, lambda x: x != 0))
    return common.durable(fit.select(F.col(vec_id).cast("bigint").alias("vec_id"), vec.alias("vec"), F.monotonically_increasing_id().alias("place")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, ascending: bool) -> np.ndarray:
    """Which pairs are among the ``k`` best of their query id; ties to smaller ids."""
    order = np.lexsort((ids, scores if ascending else -scores, query_ids))
    first = np.searchsorted(query_ids[order], query_ids[order])
    return order[np.arange(len(order)) - first < k]


def search_grid(vectors: DataFrame, queries: DataFrame, search, k: int, ascending: bool, score: pa.DataType) -> DataFrame:
    """The ``k`` best of all cells for each query id: query_id, rank, vec_id, score.

    Queries and rows are dealt into blocks of bounded size by a hash of the row's number, so that an id on many rows
    is dealt too; each pair of blocks is a cell for each length of vectors, as only vectors of one length are compared.
    ``search(query_ids, queries, ids, rows)`` gives the cell's best as three arrays (query_id, vec_id, score), at
    most ``k`` a query.  So neither side is ever held whole, and only ``k`` rows a query id and cell are
    merged.  A query id on several rows gets the best of what they find.
    """
    n, q = vectors.count(), queries.count()
    across, down = max(1, -(-n // ROWS_PER_CELL)), max(1, -(-q // QUERIES_PER_CELL))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("place", F.lit(1)), F.lit(count)).cast("int")
    left = queries.select("vec_id", "vec", F.size("vec").alias("d"), dealt(down).alias("row"), every(across).alias("col"))
    # Named anew: both sides may come from one table.
    right = vectors.select(F.col("vec_id").alias("vec_id"), F.col("vec").alias("vec"), F.size("vec").alias("d"),
                           dealt(across).alias("col"), every(down).alias("row"))

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [], [], []
        if asked.num_rows and held.num_rows:
            out = search(asked.column("vec_id").to_numpy(), matrix(asked.column("vec")),
                         held.column("vec_id").to_numpy(), matrix(held.column("vec")))
            best = _best(*out, k, ascending)
            out = tuple(c[best] for c in out)
        kinds = (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", score))
        return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds, out, strict=True)})

    best = left.groupBy("row", "col", "d").cogroup(right.groupBy("row", "col", "d")).applyInArrow(
        cell, f"query_id bigint, vec_id bigint, score {'bigint' if pa.types.is_integer(score) else 'double'}")
    order = F.col("score").asc() if ascending else F.col("score").desc()
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
