"""Token counts by a map-side two-tier lookup.

The tokenizer lower-cases, drops white space and never joins characters across
it, so the count of a text is the sum over its white-space separated
pre-tokens.  Tier 1 is a compact table {pre-token: number of tokens} of
frequent pre-tokens, at most ``TABLE_ROWS`` entries of at most
``MAX_KEY_BYTES`` bytes, broadcast to the workers.  Tier 2 encodes what misses
with the tokenizer itself, some texts together, through a bounded cache that each worker process keeps.  The
frequent pre-tokens are the most frequent of all texts, counted exactly: each task sends its counts, a row for
each distinct pre-token of up to ``COUNTER_ROWS``, and no row for each occurrence.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TABLE_ROWS = 32_768       # tier 1: entries, so at most about 4 MB
MAX_KEY_BYTES = 32
COUNTER_ROWS = 100_000    # distinct pre-tokens a task counts before it sends the counts on
SUMMARY_ROWS = 16_384     # counts in a record batch
CACHE_ROWS = 262_144      # tier 2: entries a worker keeps before it starts afresh
CACHE_KEY_BYTES = 64
CHUNK_BYTES = 1 << 20     # texts whose misses are encoded in one call; a longer text is a chunk of its own


def load(path: str):
    """The library's tokenizer of a .json file, one thread per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def lengths(tok, pre_tokens: list[bytes]) -> list[int]:
    found = tok.encode_batch_fast([p.decode("utf-8", "replace") for p in pre_tokens], add_special_tokens=False)
    return [len(e.ids) for e in found]


@functools.lru_cache(maxsize=2)
def _kept(path: str):
    """A worker process's tokenizer and cache, kept from task to task."""
    return load(path), {}


def counted_pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pre_token, n): how often each pre-token of at most ``MAX_KEY_BYTES`` bytes occurs in all texts."""
    def sent(seen: Counter) -> Iterator[pa.RecordBatch]:
        short = [k for k in seen if len(k) <= MAX_KEY_BYTES]
        for i in range(0, len(short), SUMMARY_ROWS):
            some = short[i:i + SUMMARY_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), pa.array([seen[k] for k in some], pa.int64())], names=["pre_token", "n"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for raw in common.raw_texts(batch.column(0)):
                seen.update(raw.split())
                if len(seen) > COUNTER_ROWS:
                    yield from sent(seen)
                    seen = Counter()
        yield from sent(seen)

    return (docs.select(F.col(text).alias("text")).mapInArrow(summarise, "pre_token binary, n bigint")
            .groupBy("pre_token").agg(F.sum("n").alias("n")))


def frequent_pre_tokens(docs: DataFrame, text: str = "text") -> list[bytes]:
    """The most frequent pre-tokens, at most ``TABLE_ROWS``: all that occur more than a least number of times, found from all counts.

    The driver gets the number of pre-tokens of each of the highest counts, then the
    pre-tokens above the least: at most ``TABLE_ROWS`` of them, however many share the least count.
    """
    counts = counted_pre_tokens(docs, text).persist(StorageLevel.DISK_ONLY)
    try:
        held = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n")).limit(TABLE_ROWS + 1).collect()
        least, room = 0, TABLE_ROWS
        for r in held:
            room -= r["rows"]
            if room < 0:
                least = r["n"]
                break
        return [bytes(r["pre_token"]) for r in counts.where(F.col("n") > least).select("pre_token").collect()]
    finally:
        counts.unpersist()


def count_chunk(raws: list[bytes], frequent: dict, cache: dict, encode) -> list[int]:
    """The numbers of tokens of some texts; ``encode`` gives those of the pre-tokens that neither tier holds."""
    words = [raw.split() for raw in raws]
    missed = [w for w in set().union(*words) if w not in frequent]
    known = {w: cache[w] for w in missed if w in cache}
    new = [w for w in missed if w not in known]
    if new:
        own = dict(zip(new, encode(new), strict=True))
        known |= own
        if len(cache) + len(own) > CACHE_ROWS:
            cache.clear()
        cache.update((w, n) for w, n in own.items() if len(w) <= CACHE_KEY_BYTES)
    get, second = frequent.get, known.__getitem__
    out = []
    for found in words:
        some = list(map(get, found))
        if None in some:
            out.append(sum([n if n is not None else second(w) for n, w in zip(some, found, strict=True)]))
        else:
            out.append(sum(some))
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, whole texts; a null text counts as empty.

    Rows are kept one for one: repeated rows and null ids stay, an empty table
    gives an empty result, other columns are not read.  A text without white
    space is one pre-token and is encoded whole.  Special strings inside a text
    hold no white space, so they are handled as the library does by default.
    """
    top = frequent_pre_tokens(docs, text)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(top, lengths(load(tokenizer_path), top), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cache = _kept(tokenizer_path)
        frequent = table.value

        def encode(new: list[bytes]) -> list[int]:
            return lengths(tok, new)

        for batch in batches:
            n_bytes, n_tokens, chunk, held = [], [], [], 0
            for raw in common.raw_texts(batch.column(1)):
                n_bytes.append(len(raw))
                chunk.append(raw)
                held += len(raw)
                if held >= CHUNK_BYTES:
                    n_tokens += count_chunk(chunk, frequent, cache, encode)
                    chunk, held = [], 0
            n_tokens += count_chunk(chunk, frequent, cache, encode) if chunk else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
