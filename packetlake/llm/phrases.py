"""Phrase collocations from FM-indexes over word ids.

Each task turns its texts into shards of word ids, one language each, and
builds a bidirectional index per shard: the Burrows-Wheeler transforms of the
ids and of the reversed ids, rows sorted by as many words as the longest phrase has.  A phrase is an interval in
both.  All intervals of a length are extended at once: the symbols of the reversed transform within an interval are
the words that follow the phrase, with their counts, and a phrase one word longer is kept if dropping its
first word leaves a phrase that is alive too, which the forward transform tells.

Lengths are taken one after another.  The shards' counts of a length are summed by phrase; only phrases that
reach the least count go back to their shards, which find their intervals by searching the index and extend them.
No phrase that is frequent in all is lost, as its parts are at least as frequent.  Phrases travel as the corpus-wide ids
of their words, a shard's phrases of one bucket (by the hash of the ids) as one compressed row; buckets grow in number
with the words of the corpus, not in size.  The indexes are a bucketed table and are not shuffled.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast_join
from ..session import arrow_batches
from . import common

SHARD_WORDS = 1 << 21      # words of a shard; a longer text makes a longer shard
HELD_WORDS = 3 << 20       # words that a task holds over all languages before it closes its largest shard
LONGEST = 5
BUCKET_WORDS = 1 << 21     # words of the corpus for each bucket of phrases; a bucket has fewer phrases than that, as a rule
WORD_SLICES = 1 << 20      # the ids of words are numbered within slices of their hash
BATCH_BYTES = 4 << 20      # of the indexes that a worker gets at a time; a larger shard comes alone
PART_TOPS = 8              # a task ranks about this many times the phrases that it keeps
NO_LANGUAGE = "und"
# What ends a piece, and what separates words.
_ENDS, _SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_CLEAN = bytes.maketrans(_ENDS + _SPACES, b"\n" * len(_ENDS) + b" " * len(_SPACES))
_INDEX = ("shard bigint, lang string, n_words bigint, words array<binary>, counts array<bigint>, starts array<bigint>, "
          "forward binary, backward binary")


def pieces(raw: bytes) -> list[list[bytes]]:
    """The pieces of a text as lists of words, A-Z lower-cased."""
    found = (p.split() for p in raw.lower().translate(_CLEAN).split(b"\n"))
    return [p for p in found if p]


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def sorted_rows(s: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """Start positions of the cyclic text ``s`` ordered by its first ``depth`` symbols (at least)."""
    ranks, known = s, 1
    while known < depth:
        step = min(known, depth - known)
        ranks = _ranks(ranks * (int(ranks.max(initial=0)) + 1) + np.roll(ranks, -step))
        known += step
    return np.argsort(ranks, kind="stable")


def transforms(s: np.ndarray, depth: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transforms of ``s`` and of ``s`` reversed."""
    back = s[::-1]
    return s[sorted_rows(s, depth) - 1].astype(np.int32), back[sorted_rows(back, depth) - 1].astype(np.int32)


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """The row that each row's text has when the symbol before it is put in front."""
    out = np.empty(len(bwt), np.int64)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return out


def _rows(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All rows of the intervals, one interval after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def locate(order_f: np.ndarray, order_r: np.ndarray, forward: np.ndarray, backward: np.ndarray, starts: np.ndarray, counts: np.ndarray,
           phrases: np.ndarray):
    """(f, r, n) of phrases that occur, one column of local ids each; ``order_f`` and ``order_r`` sort the transforms stably."""
    size, phrases = len(forward), phrases.astype(np.int64)     # products pass 32 bits

    def search(bwt: np.ndarray, order: np.ndarray, symbols: np.ndarray):
        keys = bwt[order].astype(np.int64) * size + order
        low, high = starts[symbols[0]], starts[symbols[0]] + counts[symbols[0]]
        for symbol in symbols[1:]:
            low, high = (np.searchsorted(keys, symbol * size + at) for at in (low, high))
        return low, high

    f, end = search(forward, order_f, phrases[::-1])
    return f, search(backward, order_r, phrases)[0], end - f


def extend(forward: np.ndarray, backward: np.ndarray, f: np.ndarray, r: np.ndarray, n: np.ndarray):
    """(parent, symbol, f, r, n) of every phrase one word longer whose first and last parts are both among the given phrases.

    ``f`` and ``r`` are where the phrases' intervals start in either index, ``n`` how long they are.
    """
    rows = _rows(r, n)
    parent, symbol = np.repeat(np.arange(len(n)), n), backward[rows].astype(np.int64)
    order = np.argsort(parent * (int(symbol.max(initial=0)) + 1) + symbol, kind="stable")
    parent, symbol, rows = parent[order], symbol[order], rows[order]
    del order
    new = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])])) if len(rows) else rows
    count = np.diff(np.append(new, len(rows)))
    parent, symbol, rows = parent[new], symbol[new], rows[new]
    # Occurrences with a smaller following symbol come first in the forward interval.
    started = np.cumsum(n) - n
    f_new, r_new = f[parent] + (new - started[parent]), last_to_first(backward)[rows]
    reached = np.zeros(len(forward), bool)
    reached[last_to_first(forward)[_rows(f, n)]] = True
    good = np.flatnonzero((symbol > 0) & reached[f_new])
    return parent[good], symbol[good], f_new[good], r_new[good], count[good]


class _Shard:
    """The ids of one language, 0 between pieces."""

    def __init__(self):
        self.known = defaultdict()
        self.known.default_factory = lambda: len(self.known) + 1
        self.parts, self.words = [[0]], 0

    def add(self, text: list[list[bytes]]) -> None:
        ids: list[int] = []
        for piece in text:
            ids.extend(map(self.known.__getitem__, piece))
            ids.append(0)
        self.parts.append(np.array(ids, np.int64))
        self.words += len(ids) - len(text)

    def row(self, shard: int, lang: str, depth: int) -> dict:
        s = np.concatenate(self.parts).astype(np.int64)
        forward, backward = transforms(s, depth)
        counts = np.bincount(s, minlength=len(self.known) + 1)
        starts = np.cumsum(counts) - counts
        return {"shard": shard, "lang": lang, "n_words": self.words, "words": list(self.known), "counts": counts[1:], "starts": starts[1:],
                "forward": forward.tobytes(), "backward": backward.tobytes()}


def build_indexes(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = LONGEST) -> DataFrame:
    """One row per shard: its words with their counts and intervals, and both transforms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, closed, open_shards = TaskContext.get().partitionId() << 32, 0, {}

        def close(name: str) -> pa.RecordBatch:
            nonlocal closed
            row = open_shards.pop(name).row(base + closed, name, depth)
            closed += 1
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), common.raw_texts(batch.column(1)), strict=True):
                shard = open_shards.get(name)
                if shard is None:
                    shard = open_shards[name] = _Shard()
                shard.add(pieces(raw))
                if shard.words >= SHARD_WORDS:
                    yield close(name)
                elif sum(s.words for s in open_shards.values()) >= HELD_WORDS:
                    yield close(max(open_shards, key=lambda k: (open_shards[k].words, k)))
        for name in sorted(open_shards):
            if open_shards[name].words:
                yield close(name)

    chosen = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, _INDEX)


def pack(columns: np.ndarray) -> bytes:
    """Integer columns of equal length as one compressed value: the first as differences, bytes of equal weight together."""
    shifted = np.array(columns, np.int64, order="C")
    shifted[0] = np.diff(shifted[0], prepend=0)
    return pa.compress(np.ascontiguousarray(shifted.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)), codec="zstd", asbytes=True)


def unpack(blob: pa.Scalar, rows: int, columns: int) -> np.ndarray:
    raw = pa.decompress(blob.as_buffer(), rows * columns * 8, codec="zstd")
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, rows)
    out = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(columns, rows)
    out[0] = np.cumsum(out[0])
    return out


def buckets_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each phrase, one column of word ids each."""
    mixed = np.zeros(words.shape[1], np.uint64)
    for column in words:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def _extend_shard(at: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word ids, counts) of the phrases of ``length`` words that a shard's alive phrases can be extended to."""
    forward, backward = (np.frombuffer(at[k].as_buffer(), np.int32) for k in ("forward", "backward"))
    starts, counts = (np.concatenate([[0], at[k].values.to_numpy(zero_copy_only=False)]) for k in ("starts", "counts"))
    local, ids = (at["known"].values.field(k).to_numpy(zero_copy_only=False) for k in ("local", "id"))
    by_id = np.argsort(ids)
    if length == 2:
        alive = ids[by_id][None, :]
    else:
        packed = at["alive"].values
        alive = np.concatenate([unpack(b, n.as_py(), length - 1) for b, n in zip(packed.field("blob"), packed.field("rows"), strict=True)], axis=1)
        alive = alive[:, np.lexsort(alive[::-1])]
    order_f, order_r = (np.argsort(t, kind="stable") for t in (forward, backward))
    f, r, n = locate(order_f, order_r, forward, backward, starts, counts, local[by_id][np.searchsorted(ids, alive, sorter=by_id)])
    del order_f, order_r
    parent, symbol, _, _, n = extend(forward, backward, f, r, n)
    word = np.zeros(len(counts), np.int64)
    word[local] = ids
    return np.concatenate([alive[:, parent], word[symbol][None, :]]), n


def _extended(length: int, buckets: int):
    """Rows of shards to (bucket, shard, rows, blob): the phrases of ``length`` words and their counts."""
    names = ("bucket", "shard", "rows", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                words, n = _extend_shard(at, length)
                if not len(n):
                    continue
                bucket = buckets_of(words, buckets)
                order = np.argsort(bucket, kind="stable")
                both = np.concatenate([words, n[None, :]])[:, order]
                there, first = np.unique(bucket[order], return_index=True)
                for b, lo, hi in zip(there.tolist(), first, np.append(first[1:], len(order)), strict=True):
                    values = (b, at["shard"].as_py(), int(hi - lo), pack(both[:, lo:hi]))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=list(names))
    return run


def _summed(length: int, least: int):
    """A bucket's rows to (shard, rows, blob): the frequent phrases with their sums (shard -1), and which of them each shard has."""
    def run(bucket: pa.Table) -> pa.Table:
        rows = bucket["rows"].to_pylist()
        parts = np.concatenate([unpack(b, n, length + 1) for b, n in zip(bucket["blob"], rows, strict=True)], axis=1)
        words, order = parts[:-1], np.lexsort(parts[-2::-1])
        ordered = words[:, order]
        new = np.concatenate([[True], (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)])
        sums = np.add.reduceat(parts[-1][order], np.flatnonzero(new))
        frequent = sums >= least
        keep = np.empty(len(order), bool)
        keep[order] = frequent[np.cumsum(new) - 1]
        out = [(-1, np.concatenate([ordered[:, new][:, frequent], sums[frequent][None, :]]))]
        ends = np.cumsum(rows)
        for shard, lo, hi in zip(bucket["shard"].to_pylist(), ends - rows, ends, strict=True):
            out.append((shard, words[:, lo:hi][:, keep[lo:hi]]))
        out = [(shard, columns) for shard, columns in out if columns.shape[1]]
        return pa.table({"shard": pa.array([s for s, _ in out], pa.int64()), "rows": pa.array([c.shape[1] for _, c in out], pa.int64()),
                         "blob": pa.array([pack(c) for _, c in out], pa.binary())})
    return run


def _named(level: DataFrame, words: DataFrame, length: int) -> DataFrame:
    """(lang, length, phrase, a) of a level's frequent phrases."""
    names = [f"w{i}" for i in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpack(blob, n, length + 1)], names=[*names, "a"])

    named = level.where("shard = -1").select("rows", "blob").mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "a"]))
    salt = F.xxhash64(*names)
    for i, name in enumerate(names):
        side = words.select(F.col("id").alias(f"_{name}"), F.col("phrase").alias(f"t{i}"), *([F.col("lang")] if i == 0 else []))
        width = F.octet_length(f"t{i}") + 24
        named = bounded_broadcast_join(named, side, name, f"_{name}", width=width, salt=salt)
    return named.select("lang", F.lit(length).alias("length"), F.concat_ws(" ", *[F.col(f"t{i}") for i in range(length)]).alias("phrase"), "a")


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, words): (lang, length, phrase, a) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n)."""
    spark = docs.sparkSession
    name = f"phrase_index_{uuid.uuid4().hex}"
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (build_indexes(docs, lang, text, longest).write.option("compression", "zstd").bucketBy(partitions, "shard").format("parquet").saveAsTable(name))
    tables = [name]

    def written(df: DataFrame, as_name: str) -> DataFrame:
        tables.append(f"{name}_{as_name}")
        df.write.option("compression", "zstd").format("parquet").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    try:
        index = spark.table(name)
        total = common.durable(index.groupBy("lang").agg(F.sum("n_words").alias("n")))
        size = total.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets = common.bucket_count(size, BUCKET_WORDS)
        # Words: one exchange serves the sums, the ids and the way back to the shards.
        counted = index.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(
            "lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"), "shard", (F.col("at") + 1).alias("local"))
        slice_of = F.pmod(F.xxhash64("lang", "phrase"), F.lit(WORD_SLICES))
        dealt = (counted.withColumn("_slice", slice_of).repartition("_slice")
                 .withColumn("a", F.sum("n").over(Window.partitionBy("_slice", "lang", "phrase"))).where(F.col("a") >= least))
        number = F.dense_rank().over(Window.partitionBy("_slice").orderBy("lang", "phrase"))
        frequent = written(dealt.withColumn("id", F.shiftleft("_slice", 40) + number).select("id", "lang", "phrase", "a", "shard", "local"), "words")
        words = common.durable(frequent.groupBy("id").agg(F.first("lang").alias("lang"), F.first("phrase").cast("string").alias("phrase"),
                                                          F.first("a").alias("a")))
        known = written(frequent.groupBy("shard").agg(F.collect_list(F.struct("local", "id")).alias("known")), "known")
        phrases = words.select("lang", F.lit(1).alias("length"), "phrase", "a")
        both = index.select("shard", "counts", "starts", "forward", "backward").join(known.hint("shuffle_hash"), "shard")
        alive = None
        for length in range(2, longest + 1):
            shards = both if alive is None else both.join(alive.hint("shuffle_hash"), "shard")
            spread = shards.mapInArrow(_extended(length, buckets), "bucket bigint, shard bigint, rows bigint, blob binary")
            with arrow_batches(spark, BATCH_BYTES):
                level = written(spread.groupBy("bucket").applyInArrow(_summed(length, least), "shard bigint, rows bigint, blob binary"), str(length))
                phrases = phrases.unionByName(common.durable(_named(level, words, length)))
            alive = level.where("shard >= 0").groupBy("shard").agg(F.collect_list(F.struct("rows", "blob")).alias("alive"))
    finally:
        for made in tables:
            spark.sql(f"DROP TABLE IF EXISTS {made}")
    return phrases, total


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, top: int = 2_000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase's score is that of its lowest-scoring cut, floor(1000 * a * n / (l * r)), ties to the smallest first
    part; phrases that only occur inside one longer candidate are dropped.  Ranked by score and count
    descending, then the phrase.  A null language is ``und``; null and empty texts have no words; repeated
    rows count each time; other columns are not read; an empty table gives an empty result.
    """
    phrases, total = frequent_phrases(docs, least, longest, lang, text)
    found = phrases.where("length > 1")
    # f(longer) is at most a; where it is equal, so it is for the phrase that is one word longer, on one side.
    words = F.split("phrase", " ")
    parts = [F.array_join(F.slice(words, start, F.col("length") - 1), " ") for start in (1, 2)]
    inside = found.where("length > 2").select("lang", "a", F.explode(F.array(*parts)).alias("phrase")).distinct()
    kept = found.join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.withColumn("_w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("rest"))
    counts = phrases.select("lang", F.col("phrase").alias("_p"), F.col("a").alias("_f"))
    cuts = (cuts.join(counts.withColumnsRenamed({"_p": "first", "_f": "l"}), ["lang", "first"])
            .join(counts.withColumnsRenamed({"_p": "rest", "_f": "r"}), ["lang", "rest"]))
    # A few rows, as a rule; measured, and salted if it is more, so that a hot language is not joined in one task.
    named = total.select(F.col("lang").alias("_lang"), "n")
    cuts = bounded_broadcast_join(cuts, named, "lang", "_lang", width=F.octet_length("_lang") + 8, salt=F.xxhash64("phrase")).drop("_lang")
    score = F.expr("(1000 * cast(a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = (cuts.withColumn("score", score)
              .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c"))
              .select("lang", "phrase", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), "n", F.col("_c.score").alias("score")))
    lowest = common.durable(lowest)
    # A language's best of each part first, round by round, so that a hot language is not sorted in one task.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some, left = lowest, lowest.count()
    while left > PART_TOPS * top:
        parts = common.bucket_count(left, PART_TOPS * top)
        best = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        some = (some.withColumn("_part", F.pmod(F.xxhash64("phrase", F.lit(left)), F.lit(parts))).withColumn("_n", best)
                .where(F.col("_n") <= top).drop("_n", "_part"))
        left = left // (PART_TOPS // 2)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
