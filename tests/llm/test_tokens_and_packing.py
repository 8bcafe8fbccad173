"""op2 and op4: counts and packing against the library and an exact round trip."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from packetlake.llm import packing, queries, token_counts
from tests.llm.conftest import SF001

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "a  b", "a   b", "a\n \nb", " \n x", "x  ", "don't I'll  'S", "<|endoftext|> a <|startoftext|>b", "a\x1c b",
       "Σας ΣΑΣ é", "日本語 テ", "word " * 5000, "x" * 20000, "same", "same"]


def noise(n):
    rnd = random.Random(5)
    parts = [" ", " ", "\n", "\t", "a", "b", "'s", "1", "!", "　", "\x1d", "é", "<|endoftext|>", "\u0301", "\x85"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def test_counts_match_the_library(spark, make_docs):
    texts = ODD + noise(500)
    docs = make_docs([*enumerate(texts), (None, "null id")])
    tok = token_counts.load(WORDS)
    got = sorted(map(tuple, token_counts.count_tokens(docs, WORDS).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids))
                   for i, t in [*enumerate(texts), (None, "null id")]), key=str)
    assert got == want


def test_pre_tokens_are_counted_in_every_text(spark, make_docs, monkeypatch):
    """40,000 texts and a counter of two entries: the counts are exact, and the table holds all above the least count that fits."""
    from pyspark.sql import functions as F

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.lit("all"), F.when(F.col("id") % 2 == 0, "even"), F.concat(F.lit("w"), F.col("id") % 10), F.lit("x" * 40)).alias("text"))
    monkeypatch.setattr(token_counts, "COUNTER_ROWS", 2)
    counts = {bytes(r.pre_token): r.n for r in token_counts.counted_pre_tokens(docs).collect()}
    assert counts == {b"all": 40_000, b"even": 20_000} | {b"w%d" % i: 4_000 for i in range(10)}
    assert set(token_counts.frequent_pre_tokens(docs)) == set(counts)
    monkeypatch.setattr(token_counts, "TABLE_ROWS", 6)
    assert set(token_counts.frequent_pre_tokens(docs)) == {b"all", b"even"}


def test_counts_without_cache_room(spark, make_docs, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ROWS", 3)
    monkeypatch.setattr(token_counts, "SUMMARY_ROWS", 1)
    texts = ["one two three four five six seven", "one eight nine ten", "eleven"]
    tok = token_counts.load(WORDS)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(make_docs(enumerate(texts)), WORDS).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_whole_table_counts(spark):
    rows = queries.op2_token_counts(spark, SF001).collect()
    tok = token_counts.load(WORDS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 2048) and r.n_bytes == len(texts[r.doc_id].encode())


def check_packing(rows, texts, tok):
    """rows: pieces of texts {doc_id: text}; an exact round trip of ids, and gapless sequences."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(texts)
    for key, pieces in docs.items():
        ids = np.asarray([*tok.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids) and len(pieces) == -(-len(ids) // 1024)
        at = 0
        for i, r in enumerate(pieces):
            assert r.start == at and (i == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_packing_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.op4_best_fit_packing(spark, SF001).collect()
    bins = check_packing(rows, texts, token_counts.load(BYTES))
    assert bins <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_ranks_give_the_ids_of_the_tokenizer_file():
    by_rank = packing.Encoder(BYTES, RANKS)
    for t in [t or "" for t in ODD] + noise(5000) + ["x" * 200_000, " " * 100_000 + "a", "\n" * 50_000, "1" * 50_000]:
        assert by_rank(t) == np.asarray(by_rank.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_odd_rows(spark, make_docs):
    texts = dict(enumerate(ODD + noise(300)))
    pieces = packing.tokenize(make_docs(texts.items()), BYTES, keep_ids=True, ranks=RANKS)
    rows = packing.pack(pieces).collect()
    check_packing(rows, texts, token_counts.load(BYTES))
    assert all(len(r.ids) == r.length for r in rows)


def test_packing_repeated_rows_and_empty_table(spark, make_docs):
    rows = packing.pack(packing.tokenize(make_docs([(None, "a b"), (1, "c"), (1, "c"), (1, "c")]), BYTES)).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.pack(packing.tokenize(make_docs([]), BYTES)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    lengths, n = np.unique(rng.integers(1, capacity + 1, int(rng.integers(1, 3000))), return_counts=True)
    used = defaultdict(int)
    bins = 0
    for times, pattern in packing.plan_bins(dict(zip(lengths.tolist(), n.tolist())), capacity):
        assert times > 0 and sum(x * k for x, k in pattern) <= capacity
        bins += times
        for x, k in pattern:
            used[x] += times * k
    assert dict(used) == dict(zip(lengths.tolist(), n.tolist()))
    assert bins <= 1.25 * (lengths * n).sum() / capacity + 1


def test_two_pieces_replace_the_smallest():
    # Greedy takes 6 + 3 and leaves a gap of 1; 2 + 2 fill what 3 and the gap leave.
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])
