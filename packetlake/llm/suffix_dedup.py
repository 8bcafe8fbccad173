"""Exact removal of repeated passages: suffix arrays built by Lyndon grouping.

Every 100-byte string (``width``) holds one minimizer, the k-gram of smallest
hash, at the same place wherever the string occurs.  So occurrences of a string
meet under their minimizer: a document is cut into contexts, one per minimizer, that
hold the strings it is the minimizer of.  Equal contexts are collapsed to the
earliest before anything is sorted.  Different contexts of one minimizer that can share a
string are laid end to end, and their suffix array brings equal strings
together; all but the earliest are removed.

The suffix array is built by grouping, without renaming or recursion: groups of
suffixes with one Lyndon prefix are taken in descending order; each suffix of
a group extends the prefix of its previous smaller suffix, which moves to a higher group; then the
groups are emitted in ascending order, each suffix after the one that follows its prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 32                    # bytes of a minimizer
BLOCK = 1 << 19              # window starts looked at together; places fit PLACE bits
PLACE = 20
NO_ID = (1 << 63) - 1        # rows without an id come after all others
_BASE = 0x9E3779B97F4A7C15   # odd, so it has an inverse modulo 2**64
_MIX = np.uint64(0xBF58476D1CE4E5B9)
COUNT_BITS = 7
CONTEXTS_TOGETHER = 1_024    # of one minimizer; more are grouped by the sides of the minimizer as well


# ---------------------------------------------------------------- suffix array by Lyndon grouping
SEPARATOR = 0xF8             # no byte of UTF-8; sorts below all others
_TURNED = bytes(254 if c == SEPARATOR else max(0, 253 - c) for c in range(256))


def lyndon_groups(text: bytes) -> tuple[list[list[int]], list[int]]:
    """(groups, ends): suffixes by their longest Lyndon prefix text[i:ends[i]], groups in descending order.

    Keys are turned (larger bytes first) and end in 0xFF, so that the smallest
    key is the largest prefix, a longer one before its own prefix.
    """
    turned, n = text.translate(_TURNED), len(text)
    ends, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    groups: dict[bytes, list[int]] = {}
    letters = np.frombuffer(turned, np.uint8)
    for c in np.unique(letters).tolist():
        groups[bytes([c, 255])] = np.flatnonzero(letters == c).tolist()
    keys, out = list(groups), []
    heapify(keys)
    while keys:
        key = heappop(keys)
        size = len(key) - 1
        members = sorted(i for i in groups.pop(key) if ends[i] - i == size and not done[i])
        if not members:
            continue
        out.append(members)
        for i in members:
            done[i] = 1
        moved = []
        for i in members:
            p = before[i]
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                ends[p] = ends[i]
                moved.append(p)
        for p in set(moved):
            key = turned[p:ends[p]] + b"\xff"
            if key in groups:
                groups[key].append(p)
            else:
                groups[key] = [p]
                heappush(keys, key)
    return out, ends


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in order (bytes of UTF-8, and SEPARATOR below all)."""
    groups, ends = lyndon_groups(text)
    n, free, at = len(text), [], [0] * len(text)
    start = 0
    for g, members in enumerate(reversed(groups)):
        free.append(start)
        start += len(members)
        for i in members:
            at[i] = g
    followers: list[list[int]] = [[] for _ in range(n + 1)]
    for i, e in enumerate(ends):
        followers[e].append(i)
    order = [0] * n
    for j in [n]:
        for i in followers[j]:
            order[free[at[i]]] = i
            free[at[i]] += 1
    for k in range(n):
        for i in followers[order[k]]:
            order[free[at[i]]] = i
            free[at[i]] += 1
    return order


def repeated_windows(contexts: list[tuple[int, int, int, bytes]], width: int) -> list[tuple[int, int, int]]:
    """(doc, digest, start) of the windows of some contexts (doc, digest, start, bytes) that occur earlier in others."""
    text = bytes([SEPARATOR]).join(c[3] for c in contexts)
    owner, offset, begin = [], [], 0
    for n, c in enumerate(contexts):
        owner += [n] * (len(c[3]) + 1)
        offset += range(len(c[3]) + 1)
        begin += len(c[3]) + 1
    ordered = [p for p in suffix_array(text) if offset[p] + width <= len(contexts[owner[p]][3])]
    found, run = [], []

    def close() -> None:
        if len(run) > 1:
            spots = [(contexts[owner[p]][0], contexts[owner[p]][1], contexts[owner[p]][2] + offset[p]) for p in run]
            least = min(s[0] for s in spots)
            first = {}
            for doc, digest, start in spots:
                if doc == least:
                    first[digest] = min(start, first.get(digest, start))
            found.extend(s for s in set(spots) if s[0] > least or s[2] > first[s[1]])

    last = b""
    for p in ordered:
        window = text[p:p + width]
        if window != last:
            close()
            run, last = [], window
        run.append(p)
    close()
    return found


# ---------------------------------------------------------------- minimizers of a document
@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = BLOCK + 4_096
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


def contexts(text: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(gram, context, sides, first, last) of one block: hashes of each minimizer, of its context and of its sides,
    and the first and last start of its windows.  A side is 0 where the block ends before it."""
    n, side = len(text), (width - GRAM) // 2
    up, down = _powers()
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashed = lambda a, b: (total[b] - total[a]) * down[a]
    grams = _mixed((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    span, low = width - GRAM + 1, np.uint64((1 << PLACE) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    # Minimum of every run of ``span`` keys, from minima towards both ends of fixed cells.
    cells = -(-len(keyed) // span)
    padded = np.full(cells * span, ~np.uint64(0))
    padded[:len(keyed)] = keyed
    grid = padded.reshape(cells, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    at = (np.minimum(back[:windows], ahead[span - 1:span - 1 + windows]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    a = at[first]
    context = _mixed(hashed(first, last + width)) ^ _mixed((a - first).astype(np.uint64) + np.uint64(7))
    left, right = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    some = a >= side
    left[some] = _mixed(hashed(a[some] - side, a[some] + GRAM)) >> np.uint64(32) | np.uint64(1)
    some = a + GRAM + side <= n
    right[some] = _mixed(hashed(a[some], a[some] + GRAM + side)) >> np.uint64(32) | np.uint64(1)
    return grams[a], context, left << np.uint64(32) | right, first, last


def _document_rows(raw: bytes, width: int) -> tuple[np.ndarray, ...]:
    """Contexts of a whole document, block by block: gram, context, sides, start, count."""
    data, parts = np.frombuffer(raw, np.uint8), []
    for at in range(0, len(data) - width + 1, BLOCK):
        gram, context, sides, first, last = contexts(data[at:at + BLOCK + width - 1], width)
        parts.append((gram, context, sides, first + at, last - first + 1))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


# ---------------------------------------------------------------- the corpus
_ROW = "kind int, gram bigint, context bigint, doc bigint, digest bigint, sides bigint, place bigint"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]
_CONTEXT, _REPEAT, _OPEN = 0, 1, 2


def _place(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << COUNT_BITS) | count.astype(np.int64)


def _start(place):
    return place >> COUNT_BITS


def _count(place):
    return place & ((1 << COUNT_BITS) - 1)


def _batch(kind, gram, context, doc, digest, sides, place) -> pa.RecordBatch:
    columns = [np.asarray(c) for c in (gram, context, doc, digest, sides, place)]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(kind, np.int32)), *[pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]], names=_NAMES)


def _known_repeats(row: np.ndarray, gram: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a context also stands earlier in its own row or in a smaller document of these rows.

    Contexts come row by row (``row`` is its number), in the order of their starts.
    """
    order = np.argsort(context, kind="stable")
    g, c, d, r = gram[order], context[order], doc[order], row[order]
    same = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(d))))
    known = np.zeros(len(doc), bool)
    known[order] = (d > least) | np.concatenate([[False], same & (r[1:] == r[:-1])])
    return known


def _context_rows(keyed: DataFrame, width: int) -> DataFrame:
    """One row per context of a document.

    Of contexts that a document repeats, the later ones are repeats at once; so
    are those that a smaller document of the same batch has.  A passage that a
    third of the corpus shares thus sends one row a batch to its minimizer.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for n, (doc, digest, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                   common.raw_texts(batch.column(2)), strict=True)):
            if len(raw) >= width:
                gram, context, sides, start, count = _document_rows(raw, width)
                parts.append((np.full(len(gram), n), gram, context, np.full(len(gram), doc), np.full(len(gram), digest), sides, _place(start, count)))
        if not parts:
            return None
        row, gram, context, doc, digest, sides, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        known = _known_repeats(row, gram, context, doc)
        gram, context, sides = (np.where(known, np.uint64(0), c) for c in (gram, context, sides))   # no longer needed
        return _batch(np.where(known, _REPEAT, _CONTEXT), gram, context, doc, digest, sides, place)

    return common.map_batches(keyed.select("doc", "digest", "text"), work, _ROW)


def _meet(rows: DataFrame) -> DataFrame:
    """Repeats (all but the earliest of equal contexts) and open rows (earliest ones that may share strings with others)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not kept:
            return
        kind, gram, context, doc, digest, sides, place = (np.concatenate(c) for c in zip(*kept, strict=True))
        del kept
        known = kind == _REPEAT
        if known.any():
            yield _batch(kind[known], gram[known], context[known], doc[known], digest[known], sides[known], place[known])
        order = np.flatnonzero(~known)
        order = order[np.argsort(gram[order], kind="stable")]
        g = gram[order]
        same = g[1:] == g[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        order = order[np.lexsort((place[order], digest[order], doc[order], context[order], gram[order]))]
        if not len(order):
            return
        gram, context, doc, digest, sides, place = (c[order] for c in (gram, context, doc, digest, sides, place))
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = doc > least
        if later.any():
            none = np.zeros(later.sum(), np.int64)
            yield _batch(np.full(later.sum(), _REPEAT), none, none, doc[later], digest[later], none, place[later])
        gram, context, doc, digest, sides, place = (c[~later] for c in (gram, context, doc, digest, sides, place))
        shared = np.zeros(len(gram), bool)
        for key in (sides.view(np.uint64) >> np.uint64(32), sides.view(np.uint64) & np.uint64(0xFFFFFFFF)):
            o = np.lexsort((key, gram))
            twin = (gram[o[1:]] == gram[o[:-1]]) & (key[o[1:]] == key[o[:-1]]) & (key[o[1:]] != 0)
            shared[o[1:][twin]] = True
            shared[o[:-1][twin]] = True
        if shared.any():
            none = np.zeros(shared.sum(), np.int64)
            yield _batch(np.full(shared.sum(), _OPEN), gram[shared], none, doc[shared], digest[shared], sides[shared], place[shared])

    # Known repeats need not meet their minimizer: they are dealt evenly.
    key = F.when(F.col("kind") == _REPEAT, F.xxhash64("doc", "digest", "place")).otherwise(F.col("gram"))
    return rows.repartition(key).mapInArrow(work, _ROW)


def _grouped(open_rows: DataFrame) -> DataFrame:
    """Open rows with the group that they are sorted in, as ``gram``: their minimizer.

    A minimizer with more than ``CONTEXTS_TOGETHER`` contexts is split by its
    sides, and a row goes to the group of either side.  A string reaches beyond the
    minimizer by a side's length to the left or to the right, so all contexts that
    hold it meet in the group of that side.
    """
    hot = common.durable(open_rows.groupBy(F.col("gram").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
                         .where(F.col("_n") > CONTEXTS_TOGETHER).select("_h"))
    left, right = F.shiftrightunsigned("sides", 32), F.col("sides").bitwiseAND((1 << 32) - 1)
    split = F.array_compact(F.array(*[F.when(side != 0, F.xxhash64("gram", side, F.lit(n))) for n, side in enumerate((left, right))]))
    groups = F.when(F.col("_h").isNull(), F.array("gram")).otherwise(split)
    return open_rows.join(hot, F.col("gram") == F.col("_h"), "left").select("doc", "digest", "place", F.explode(groups).alias("gram"))


def _resolve(keyed: DataFrame, open_rows: DataFrame, width: int) -> DataFrame:
    """(doc, digest, place) of repeated windows: the open contexts of each group through one suffix array."""
    asked = (_grouped(open_rows).groupBy(F.col("doc").alias("_d"), F.col("digest").alias("_g"))
             .agg(F.collect_list(F.struct("gram", "place")).alias("asked")))
    both = keyed.join(asked, (F.col("doc") == F.col("_d")) & (F.col("digest") == F.col("_g")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, docs, digests, places, bodies = [], [], [], [], []
        for doc, digest, raw, asked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), common.raw_texts(batch.column(3)),
                                           batch.column(4).to_pylist(), strict=True):
            for one in {(a["gram"], a["place"]) for a in asked}:
                start, count = _start(one[1]), _count(one[1])
                grams.append(one[0])
                docs.append(doc)
                digests.append(digest)
                places.append(one[1])
                bodies.append(raw[start:start + count - 1 + width])
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(docs, pa.int64()), pa.array(digests, pa.int64()),
                                           pa.array(places, pa.int64()), pa.array(bodies, pa.binary())],
                                          names=["gram", "doc", "digest", "place", "body"])

    # With doc_id the rows are those of the last join, so Spark shuffles the texts once for both.
    pieces = common.map_batches(both.select("doc_id", "doc", "digest", "text", "asked"), cut,
                                "gram bigint, doc bigint, digest bigint, place bigint, body binary")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held):
            if len(held) < 2:
                return []
            hits = repeated_windows(sorted({(d, g, _start(p), b) for d, g, p, b in held}), width)
            return [(d, g, (s << COUNT_BITS) | 1) for d, g, s in hits]

        gram, held = None, []
        for batch in batches:
            out = []
            for key, doc, digest, place, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != gram:
                    out += close(held)
                    gram, held = key, []
                held.append((doc, digest, place, body))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "digest", "place"])
        if out := close(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "digest", "place"])

    return pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(solve, "doc bigint, digest bigint, place bigint")


def remove_repeats(docs: DataFrame, width: int = 100, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row; texts are UTF-8 bytes, null is empty.

    A byte goes if a ``width``-byte string that covers it also starts earlier:
    in a smaller doc_id, or earlier in the same row.  Rows without an id come after all
    others; rows that share an id (repeated rows too) are not earlier than each other.
    ``width`` may be from 66 to 150.
    """
    if not GRAM + 34 <= width <= 150:
        raise ValueError("width must be from 66 to 150")
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc"),
                        F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    met = common.durable(_meet(_context_rows(keyed, width)))
    windows = _resolve(keyed, met.where(F.col("kind") == _OPEN), width)
    repeats = met.where(F.col("kind") == _REPEAT).select("doc", "digest", "place").unionByName(windows)
    by_doc = (repeats.groupBy(F.col("doc").alias("_d"), F.col("digest").alias("_g"))
              .agg(F.collect_list("place").alias("places")))
    joined = keyed.join(by_doc, (F.col("doc") == F.col("_d")) & (F.col("digest") == F.col("_g")), "left").select("doc_id", "text", "places")

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = ([], [], [], [], [])
        places = batch.column(2)
        for i, raw in enumerate(common.raw_texts(batch.column(1))):
            one, kept, removed, spans = places[i], raw, 0, 0
            if one.is_valid:
                p = one.values.to_numpy(zero_copy_only=False)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, _start(p), 1)
                np.add.at(edge, _start(p) + _count(p) - 1 + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                removed = len(raw) - len(kept)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            for column, value in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            arrays, names = [*arrays, pa.array(out[4], pa.binary())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")
    return common.map_batches(joined, apply, schema)
