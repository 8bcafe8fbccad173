"""Exact top-k by multi-resolution segment statistics.

Vectors are cut into segments; with the mean m and deviation s of a segment of
length w, the squared distance of two vectors is at least the sum of
w * ((m - m')**2 + (s - s')**2), and more segments give a closer bound.  As
2 * q.x = |q|**2 + |x|**2 - distance**2, a lower bound of the distance is an
upper bound of the inner product.  Coarse bounds are taken for all candidates
of a cell, finer ones for those that may still be among the best, and exact
integer products for the survivors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vectors as V

SEGMENTS = (4, 8, 16, 32)     # coarse to fine; levels as fine as the vectors are left out
QUERY_ROWS = 128              # queries whose coarse bounds are held at a time


def segment_features(rows: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations: the distance of two feature rows is the bound at this resolution."""
    parts = np.array_split(rows, segments, axis=1)
    width = np.sqrt([p.shape[1] for p in parts])
    return np.hstack([np.stack([p.mean(axis=1) for p in parts], 1) * width, np.stack([p.std(axis=1) for p in parts], 1) * width])


def search_cell(query_ids, queries, ids, rows, k: int):
    """The ``k`` largest inner products of each query among ``rows``, its own id left out, ties to smaller ids."""
    levels = [s for s in SEGMENTS if s < rows.shape[1]]
    row_features = [segment_features(rows, s) for s in levels]
    norms = (rows * rows).sum(axis=1)
    exact_rows = rows.astype(np.int64)
    found = []
    for at in range(0, len(queries), QUERY_ROWS):
        some = queries[at:at + QUERY_ROWS]
        some_features = [segment_features(some, s) for s in levels]
        some_norms = (some * some).sum(axis=1)
        coarse = (some_norms[:, None] + norms - _distances(some_features[0], row_features[0])) / 2 if levels else None
        for i in range(len(some)):
            own = ids != query_ids[at + i]
            left = np.flatnonzero(own)
            exact_query = some[i].astype(np.int64)
            # Bounds are in floating point: they get this much more than rounding can take.
            slack = 1e-9 * (some_norms[i] + norms.max(initial=0)) + 1e-6
            if levels and len(left) > k:
                bound = coarse[i][left]
                likely = left[np.argpartition(-bound, k - 1)[:k]]
                least = np.sort(exact_rows[likely] @ exact_query)[0]
                left = left[bound + slack >= least]
                for features, own_features in zip(row_features[1:], some_features[1:], strict=True):
                    if len(left) <= k:
                        break
                    apart = ((features[left] - own_features[i]) ** 2).sum(axis=1)
                    bound = (some_norms[i] + norms[left] - apart) / 2
                    best = left[np.argpartition(-bound, k - 1)[:k]]
                    least = max(least, np.sort(exact_rows[best] @ exact_query)[0])
                    left = left[bound + slack >= least]
            score = exact_rows[left] @ exact_query
            order = np.lexsort((ids[left], -score))[:k]
            found.append((np.full(len(order), query_ids[at + i]), ids[left][order], score[order]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def exact_top_k(rows: DataFrame, is_query, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of floor(scale * component), all if fewer.

    ``is_query`` is a condition over vec_id.  Which rows take part, see
    :func:`vectors.searchable`; scores must fit a long.
    """
    held = V.searchable(rows, vec_id, vector)

    def search(query_ids, queries, ids, members):
        return search_cell(query_ids, np.floor(queries * scale), ids, np.floor(members * scale), k)

    return V.search_grid(held, held.where(is_query), search, k, False, pa.int64())
