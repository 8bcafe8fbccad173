"""SimHash near duplicates by sharded BK-trees.

A document's fingerprint holds the majority bits of its shingles' hashes.
Equal fingerprints form one class.  Classes within ``radius`` bits agree on one
of ``radius + 1`` bands, so they meet in the shard of that band's value.  In
each shard a BK-tree (children keyed by their integer Hamming distance to the
parent) is searched along the edges within the radius, and gives the shard's
components as stars, never all pairs.  A shard above ``SHARD_ROWS`` is split by
the bands of its remaining bits, so after a few levels its size is bounded by
the number of values that are left.

The trees go to their queries through the shuffle: a broadcast of all trees
would pass every fingerprint through the driver and grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHARD_ROWS = 2_048     # a larger shard is split by further bands
LEVELS = 4             # 64 bits by thirds, four times: 12 or 13 bits are left, so at most 8,192 fingerprints a shard
HASHES_AT_A_TIME = 1 << 15


def fingerprint(raw: bytes, shingle_words: int, seed: int) -> int:
    """The majority bits of the XXH64 of the word shingles of a text, 0 without words."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()      # bytes: only A-Z change, only [\x20\x09-\x0D] separate
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle_words] + 1]).tolist()
    cuts = zip(starts, ends[shingle_words - 1:].tolist(), strict=True)
    n, votes = len(starts), np.zeros(64, np.int64)
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in cuts), "<u8", n)
    for at in range(0, n, HASHES_AT_A_TIME):
        part = hashes[at:at + HASHES_AT_A_TIME]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, fp) of every row, whole texts; fp is the fingerprint as a signed long, null texts are empty.

    digest, a hash of the text, tells rows of one doc_id apart.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = [fingerprint(raw, shingle_words, seed) for raw in common.raw_texts(batch.column(2))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.asarray(codes, np.uint64).view(np.int64))],
                                          names=["doc_id", "digest", "fp"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    return common.map_batches(rows, work, "doc_id bigint, digest bigint, fp bigint")


class BKTree:
    """Codes in a tree whose edges carry the Hamming distance between child and parent."""

    def __init__(self):
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        at, new = 0, len(self.codes)
        self.codes.append(code)
        self.children.append({})
        while new:
            d = (self.codes[at] ^ code).bit_count()
            child = self.children[at].setdefault(d, new)
            if child == new:
                return
            at = child

    def within(self, code: int, radius: int) -> list[int]:
        """Numbers of the codes at most ``radius`` bits away; only edges within the radius are followed."""
        found, ahead = [], [0] if self.codes else []
        while ahead:
            at = ahead.pop()
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            for edge in range(max(1, d - radius), d + radius + 1):
                if edge in children:
                    ahead.append(children[edge])
        return found


def star_links(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """(code, first code of its component) of the linked codes of one shard, the first ones left out."""
    tree, parent = BKTree(), list(range(len(codes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, code in enumerate(codes):
        for j in tree.within(code, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(code)
    return [(codes[i], codes[r]) for i in range(len(codes)) if (r := root(i)) != i]


def _paths(level: int, parts: int, free: tuple[int, ...] = tuple(range(64))) -> list[int]:
    """Masks of the bits that the members of a shard agree on, by path of bands down to ``level``."""
    bands = [b.tolist() for b in np.array_split(np.asarray(free), parts)]
    masks = []
    for band in bands:
        mask = sum(1 << b for b in band)
        rest = tuple(b for b in free if b not in band)
        masks += [mask | m for m in _paths(level - 1, parts, rest)] if level else [mask]
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(members: DataFrame, radius: int) -> DataFrame:
    """(a, b): star links of every shard of ``members`` (key, fp), one tree a shard."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            out = []
            for key, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != shard:
                    out += star_links(held, radius)
                    shard, held = key, []
                held.append(code & 0xFFFFFFFFFFFFFFFF)
            if out:
                yield _pairs(out)
        if out := star_links(held, radius):
            yield _pairs(out)

    def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.asarray(found, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    return (members.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
            .mapInArrow(work, "a bigint, b bigint"))


def fingerprint_links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints that connect all that lie within ``radius`` bits.

    ``codes`` has one column ``fp`` of distinct longs.
    """
    parts, found = radius + 1, None
    rows, paths = codes.withColumn("path", F.lit(-1)), [-1]
    for level in range(LEVELS):
        masks = _paths(level, parts)
        # Members of path p go to the paths p * parts ... of this level.
        keyed = None
        for p in paths:
            first = max(p, 0) * parts
            new = F.array(*[F.struct(F.lit(q).alias("path"),
                                     F.xxhash64(F.lit(q), F.col("fp").bitwiseAND(F.lit(_signed(masks[q])).cast("bigint"))).alias("key"))
                            for q in range(first, first + parts)])
            keyed = F.when(F.col("path") == p, new) if keyed is None else keyed.when(F.col("path") == p, new)
        rows = rows.select("fp", F.explode(keyed).alias("to")).select("fp", "to.path", "to.key").distinct()
        shards = common.durable(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        last = level == LEVELS - 1
        members = rows.join(shards, "key")
        links = _linked(members if last else members.where(F.col("n") <= SHARD_ROWS), radius)
        found = links if found is None else found.unionByName(links)
        if last or not shards.where(F.col("n") > SHARD_ROWS).count():
            return found
        rows, paths = members.where(F.col("n") > SHARD_ROWS).select("fp", "path"), list(range(len(masks)))
    return found


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2, seed: int = 42,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, fp, component_id, root) of every row: the smallest doc_id reachable over links of ``radius`` bits.

    root is the smallest fingerprint of the component: two components that hold different rows of one doc_id may
    share their component_id, but not their root.

    Texts without words (null, empty, white space) have fingerprint 0 and are
    linked like any other.  Repeated rows stay; null ids stay and do not name a
    component (null only if no member has an id).
    """
    marked = common.durable(fingerprints(docs, shingle_words, seed, doc_id, text))
    classes = common.durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fingerprint_links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.durable(rooted.join(names, "root").select("fp", "component_id", "root"))
    return marked.join(named, "fp").select("doc_id", "digest", "fp", "component_id", "root")


def hex_code(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
