"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Documents become pieces (token ids and an end id, at most ``capacity``
tokens).  Packing needs only how many pieces there are of each length, at most
``capacity`` numbers, so the driver plans over that histogram: a bin is filled
greedily with the longest piece that fits, then its smallest piece is replaced
by the two unpacked pieces that fit the expanded gap most tightly, while that
helps.  A bin's pattern is repeated as often as the counts allow, so the plan
holds a few thousand patterns at any corpus size.  Spark ranks the pieces of
each length (hot lengths in many buckets), and a piece's rank gives its bin and
place.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import load

def load_ranks(path: str, pattern: str):
    """The vocabulary of a rank file for the library that encodes by ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, as the tokenizer file at ``path`` gives them.

    With the same vocabulary as a rank file, texts are encoded by ranks, which
    gives the same ids several times faster; the special strings of the tokenizer file are
    found first, as its library does by default, and what the rank encoder refuses
    goes through the tokenizer file.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None = None):
        self.tok = load(path)
        self.ranks = load_ranks(*ranks) if ranks else None
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __call__(self, text: str) -> bytes:
        if self.ranks is None:
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        try:
            return b"".join(array("I", [self.special[p]] if p in self.special else self.ranks.encode_ordinary(p)).tobytes() for p in parts)
        except ValueError:
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, ranks: tuple[str, str] | None) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path, ranks)


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
             doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, ranks: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, whole texts.

    A null or empty text is the end id alone.  Only documents longer than
    ``capacity`` are cut; the first piece takes what does not fill a piece.
    Repeated rows and null ids give pieces of their own.  ``ranks``: (rank
    file of the same vocabulary, pattern), see :class:`Encoder`.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, ranks), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = ([], [], [], [], [], [])
            for key, body in zip(keys, common.texts(batch.column(1)), strict=True):
                ids = encode(body) + end
                n, start, piece = len(ids) // 4, 0, 0
                size = n % capacity or capacity
                while start < n:
                    part = ids[4 * start:4 * (start + size)]
                    for column, value in zip(rows, (key, piece, start, size, zlib.crc32(part), part), strict=True):
                        column.append(value)
                    start, piece, size = start + size, piece + 1, capacity
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                flat = pa.array(np.frombuffer(b"".join(rows[5]), "<u4").astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(rows[3], dtype=np.int64)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat.cast(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, schema)


def _largest(left: np.ndarray, most: int) -> int:
    """The largest length up to ``most`` that is left, or 0."""
    found = np.flatnonzero(left[:most + 1])
    return int(found[-1]) if found.size and most > 0 else 0


def _best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """Two lengths that are left and fill ``room`` most, (0, 0) if there are none."""
    have = np.flatnonzero(left[:room])
    if not have.size:
        return 0, 0
    at = np.searchsorted(have, room - have, side="right") - 1
    partner = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    alone = (partner == have) & (left[have] < 2)          # the same length twice needs two pieces
    at = np.where(alone, at - 1, at)
    partner = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    total = np.where(partner > 0, have + partner, 0)
    best = int(total.argmax())
    return (int(have[best]), int(partner[best])) if total[best] else (0, 0)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, how many per bin)]) patterns that use up the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = []
    while left.any():
        bin_, gap, pool = {}, capacity, left.copy()
        while length := _largest(pool, gap):
            n = int(min(gap // length, pool[length]))
            bin_[length] = bin_.get(length, 0) + n
            pool[length] -= n
            gap -= n * length
        while gap and bin_:
            small = min(bin_)
            a, b = _best_two(pool, gap + small)
            if a + b <= small:
                break
            bin_[small] -= 1
            if not bin_[small]:
                del bin_[small]
            pool[small] += 1
            for x in (a, b):
                bin_[x] = bin_.get(x, 0) + 1
                pool[x] -= 1
            gap -= a + b - small
        times = int(min(left[x] // n for x, n in bin_.items()))
        for x, n in bin_.items():
            left[x] -= times * n
        plan.append((times, sorted(bin_.items(), reverse=True)))
    return plan


def intervals(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as sorted rank intervals of each length: first rank, per bin, first bin, offset."""
    used, base, rows = [0] * (capacity + 1), 0, []
    for times, bin_ in plan:
        offset = 0
        for length, n in bin_:
            rows.append((length, used[length], n, base, offset))
            used[length] += times * n
            offset += n * length
        base += times
    rows.sort()
    columns = np.asarray(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per_bin", "bin", "offset"), columns, strict=True))


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset; every piece has ``length`` from 1 to ``capacity``.

    Rows of one length are ranked by doc_id, piece and checksum; equal rows may
    change places without effect on the sequences' contents.
    """
    pieces = common.durable(pieces)
    n = pieces.count()
    order = ["doc_id", "piece", "start", "ids_crc32"]
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(common.bucket_count(n))))
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = pieces.sparkSession.sparkContext.broadcast(intervals(plan_bins(histogram, capacity), capacity))
    ranked = common.running_total(keyed, ["length"], order, F.lit(1), "_bucket", "_rank").drop("_bucket")
    columns = pieces.columns

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        plan = where.value
        length = batch.column(columns.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(np.int64)
        # The interval of a (length, rank): within the length's own run of intervals, the last that begins at or before it.
        at = np.empty(len(length), np.int64)
        for x in np.unique(length):
            lo, hi = np.searchsorted(plan["length"], [x, x + 1])
            rows = length == x
            at[rows] = lo + np.searchsorted(plan["rank"][lo:hi], rank[rows], side="right") - 1
        since = rank - plan["rank"][at]
        sequence = plan["bin"][at] + since // plan["per_bin"][at]
        offset = plan["offset"][at] + since % plan["per_bin"][at] * length
        return pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(sequence), pa.array(offset)],
                                          names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id bigint, offset bigint"
    return common.map_batches(ranked.select(*columns, "_rank"), place, schema)
