"""Hard negatives by a secondary-sort shuffle.

Scores of (anchor, row) pairs are taken in cells, blocks of anchors against
blocks of rows.  A cell passes on the best rows of the anchor's label first,
from which each anchor's positives and so its score windows follow; then the best rows
of other labels within those windows.  Positives and negatives meet under the key
(anchor, descending score, kind, id): they are dealt by anchor and sorted within
the partition, and one pass over the sorted rows opens a window at each
positive and gives out the negatives that fall into open ones.  No anchor's
rows are held: the state is its open windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ANCHORS_PER_CELL = 1_024
ROWS_PER_CELL = 8_192
POSITIVE, NEGATIVE = 0, 1      # at equal scores a window opens before it is used
_FOUND = "anchor bigint, anchor_id bigint, score bigint, kind int, vec_id bigint"


def labelled(rows: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, vec): rows that take part, with vec = floor(scale * component).

    Null ids, null labels and vectors that are null, empty or hold null or
    non-finite components take no part.
    """
    vec = F.col(vector)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ~bad)
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    return fit.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), whole.alias("vec"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _first(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``at``, the ``k`` of highest score, ties to smaller ids."""
    if len(at) > 4 * k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def best_positives(score, anchor_ids, anchor_labels, ids, labels, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor row, row): the ``k`` best other rows of each anchor's label."""
    out = []
    for i in range(len(anchor_ids)):
        at = np.flatnonzero((labels == anchor_labels[i]) & (ids != anchor_ids[i]))
        got = _first(score[i], ids, at, k)
        out.append((np.full(len(got), i), got))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def best_in_windows(score, anchor_labels, windows, ids, labels, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor row, row): rows of another label that are among the ``k`` best of some window of the anchor, once each."""
    out = []
    for i, spans in enumerate(windows):
        other = labels != anchor_labels[i]
        got = [_first(score[i], ids, np.flatnonzero(other & (score[i] >= lo) & (score[i] <= hi)), k) for lo, hi in set(spans)]
        got = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
        out.append((np.full(len(got), i), got))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into the cells of a grid; only vectors of one length meet."""
    across, down = common.bucket_count(n_rows, ROWS_PER_CELL), common.bucket_count(n_anchors, ANCHORS_PER_CELL)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda key, count: F.pmod(F.xxhash64(key, F.lit(3)), F.lit(count)).cast("int")
    left = anchors.withColumn("row", dealt("anchor", down)).withColumn("col", every(across)).withColumn("d", F.size("vec"))
    # Named anew: both sides may come from one table.
    right = rows.select(dealt("place", across).alias("col"), every(down).alias("row"), F.size("vec").alias("d"),
                        *[F.col(c).alias(c) for c in ("vec_id", "label", "vec")])
    return left.groupBy("row", "col", "d"), right.groupBy("row", "col", "d")


def _table(asked: pa.Table, held: pa.Table, kind: int, at: np.ndarray, got: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"anchor": asked.column("anchor").to_numpy()[at], "anchor_id": asked.column("vec_id").to_numpy()[at],
                     "score": score[at, got], "kind": np.full(len(at), kind, np.int32), "vec_id": held.column("vec_id").to_numpy()[got]})


def _nothing() -> pa.Table:
    return pa.table({"anchor": pa.array([], pa.int64()), "anchor_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()),
                     "kind": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64())})


def give_out(rows: Iterator[tuple], negatives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (anchor, anchor_id, score, kind, vec_id).

    ``rows`` come anchor by anchor, scores descending, positives before
    negatives of the same score.
    """
    current, open_windows = None, []
    for anchor, anchor_id, score, kind, vec_id in rows:
        if anchor != current:
            current, open_windows = anchor, []
        if kind == POSITIVE:
            open_windows.append([vec_id, score, *window(score, low, high), 0])
            continue
        for w in open_windows:
            if w[2] <= score <= w[3] and w[4] < negatives:
                w[4] += 1
                yield anchor_id, w[0], w[4], vec_id, w[1], score


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Every row that meets ``is_anchor`` (a condition over vec_id) is an anchor of its own.  Its positives are its
    first ``positives`` rows of the same label with another id, by the inner product of floor(scale * component), higher first, ties
    by smaller id; for each, the first ``negatives`` rows of other labels whose score is between ``low`` and ``high``
    per cent of the positive's.  All, if fewer.  Rows that share an id each take part, and the same negative may serve
    several positives.  Which rows take part, see :func:`labelled`; vectors of another length than the
    anchor's are not compared with it.  Scores must fit a long.  Empty tables give an empty result; other columns are not read.
    """
    held = common.durable(labelled(rows, scale, vec_id, vector, label).withColumn("place", F.monotonically_increasing_id()))
    anchors = held.where(is_anchor).withColumnRenamed("place", "anchor")
    n_rows, n_anchors = held.count(), anchors.count()

    def near(asked: pa.Table, others: pa.Table) -> pa.Table:
        if not (asked.num_rows and others.num_rows):
            return _nothing()
        score = products(matrix(asked.column("vec")), matrix(others.column("vec")))
        names = [t.column(c).to_numpy() for t in (asked, others) for c in ("vec_id", "label")]
        return _table(asked, others, POSITIVE, *best_positives(score, *names, positives), score)

    left, right = _cells(anchors, held, n_anchors, n_rows)
    first = left.cogroup(right).applyInArrow(near, _FOUND)
    best = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    chosen = common.durable(first.withColumn("_n", best).where(F.col("_n") <= positives).drop("_n"))

    # The windows travel with their anchor; anchors without a positive have none and go no further.
    windowed = anchors.join(chosen.groupBy("anchor").agg(F.collect_list("score").alias("positive_scores")), "anchor")

    def between(asked: pa.Table, others: pa.Table) -> pa.Table:
        if not (asked.num_rows and others.num_rows):
            return _nothing()
        score = products(matrix(asked.column("vec")), matrix(others.column("vec")))
        spans = [[window(s, low, high) for s in found] for found in asked.column("positive_scores").to_pylist()]
        return _table(asked, others, NEGATIVE, *best_in_windows(
            score, asked.column("label").to_numpy(), spans, others.column("vec_id").to_numpy(), others.column("label").to_numpy(), negatives), score)

    left, right = _cells(windowed, held, n_anchors, n_rows)
    second = left.cogroup(right).applyInArrow(between, _FOUND)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []
        for row in give_out(each(), negatives, low, high):
            out.append(row)
            if len(out) == 8_192:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    pairs = chosen.unionByName(second).select("anchor", "anchor_id", "score", "kind", "vec_id")
    ordered = pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "vec_id")
    return ordered.mapInArrow(stream, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                      "positive_score bigint, negative_score bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    columns = [pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(names))
