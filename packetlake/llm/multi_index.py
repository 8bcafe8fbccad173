"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample (iterative quantisation: principal axes,
then the rotation that loses least when signs are taken) turn a vector into a
binary code.  Codes are cut into substrings of one byte and each substring is
indexed.  A code within ``radius`` of the query's is, by the pigeonhole
principle, within radius // substrings bits in some substring, so probing the
substring values that near retrieves every code within the radius; those are
checked on the whole code and ranked by exact distance.  Every row is indexed,
in shards of bounded size; a query that finds too few in a shard widens its radius
there, up to the whole shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V

TRAIN_ROWS = 8_192       # sample that rotations and radius are learned on: the rows of smallest id hash
ROTATIONS = 4            # learned rotations; each gives one bit per dimension
ROUNDS = 30
SAMPLE_QUERIES = 256
COVERED = 0.98           # share of the sample's true neighbours that lie within the radius


def learn(sample: np.ndarray, k: int = 10, rotations: int = ROTATIONS, seed: int = 11) -> dict:
    """Centre, projections and radius from a sample of vectors."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    x = sample - centre
    axes = np.linalg.svd(x, full_matrices=False)[2].T if len(x) >= x.shape[1] else np.eye(x.shape[1])
    v, projections = x @ axes, []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        projections.append(axes @ turn)
    index = {"centre": centre, "axes": np.hstack(projections)}
    asked = sample[:SAMPLE_QUERIES]
    apart = _apart(asked, sample)
    np.put_along_axis(apart, np.arange(len(asked))[:, None], np.inf, axis=1)
    near = np.argsort(apart, axis=1)[:, :min(k, max(1, len(sample) - 1))]
    codes = encode(sample, index)
    bits = np.bitwise_count(codes[:len(asked), None] ^ codes[near]).sum(axis=2)
    return index | {"radius": int(np.quantile(bits, COVERED)) if bits.size else 0}


def encode(rows: np.ndarray, index: dict) -> np.ndarray:
    """One byte per substring."""
    return np.packbits((rows - index["centre"]) @ index["axes"] >= 0, axis=1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)


class MultiIndex:
    """Codes with one table per substring: the rows of each of its 256 values."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.rows, strict=True)]
        values = np.arange(256, dtype=np.uint8)
        self.bits = np.bitwise_count(values[:, None] ^ values)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is at most ``radius`` bits from ``code``.

        With radius = m * each + more (m substrings), one of the first more + 1
        substrings is within ``each`` bits or one of the others within each - 1.
        """
        m = self.codes.shape[1]
        each, more = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = each if j <= more else each - 1
            if reach >= 0:
                starts, rows = self.starts[j], self.rows[j]
                for value in np.flatnonzero(self.bits[code[j]] <= reach):
                    seen[rows[starts[value]:starts[value + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def search_shard(query_ids, queries, ids, rows, index: dict, k: int):
    """The ``k`` nearest found of each query in one shard, its own id left out, ties to smaller ids."""
    codes, asked = encode(rows, index), encode(queries, index)
    tables, top = MultiIndex(codes), codes.shape[1] * 8
    found = []
    for i in range(len(queries)):
        radius = index["radius"]
        while True:
            near = tables.within(asked[i], radius)
            near = near[ids[near] != query_ids[i]]
            if len(near) >= k or radius >= top:
                break
            radius = min(top, radius + codes.shape[1])
        apart = np.sqrt(((rows[near] - queries[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], apart))[:k]
        found.append((np.full(len(order), query_ids[i]), ids[near][order], apart[order]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def nearest(rows: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by Euclidean distance, all if fewer.

    ``is_query`` is a condition over vec_id.  Which rows take part, see
    :func:`vectors.searchable`; zero vectors take none.
    """
    held = V.searchable(rows, vec_id, vector, zero=False)
    spark = rows.sparkSession
    # The index is learned for the commonest length; vectors of another length learn theirs in their cell.
    common = held.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    length = common["d"] if common else 0
    sample = held.where(F.size("vec") == length).orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(TRAIN_ROWS).select("vec").toArrow()
    index = learn(V.matrix(sample.column("vec")), k) if sample.num_rows else {}
    shared = spark.sparkContext.broadcast(index)

    def search(query_ids, queries, ids, members):
        own = shared.value if members.shape[1] == length else learn(members, k)
        return search_shard(query_ids, queries, ids, members, own, k)

    return V.search_grid(held, held.where(is_query), search, k, True, pa.float64())
