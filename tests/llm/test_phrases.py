"""op13 against brute force; the SQL is compared in test_oracles."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetlake import session
from packetlake.llm import phrases as P
from tests.llm.conftest import SF001


def brute(rows, least, longest=5, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in P.pieces((text or "").encode()):
            total[lang] += len(piece)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(piece[i:i + m])) for i in range(len(piece) - m + 1))
    found, out = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}, []
    covered = {(lang, w[i:j]) for (lang, w), a in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
               if j - i < len(w) and (lang, w[i:j]) in found and a >= found[lang, w[i:j]]}
    for (lang, w), a in found.items():
        if (lang, w) not in covered:
            n = total[lang]
            cuts = [(1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, b" ".join(w), counts[lang, w[:k]], counts[lang, w[k:]], n))
    ranked, at = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr(
        "*", "0 AS phrase", "0 AS a", "0 AS shard", "0 AS n", "0 AS rank", "0 AS words", "0 AS alive", "0 AS length")
    return sorted(map(tuple, P.collocations(df, **more).collect()))


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_given_texts(spark, monkeypatch, shard):
    monkeypatch.setattr(P, "SHARD_WORDS", shard)
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()][:60]
    want = brute(rows, 20)
    assert found(spark, rows, least=20) == sorted(want) and want


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), (None, "a b"), ("und", "A  b\tc. a b c"), ("en", ".,;"), ("en", "x " * 3000), ("en", "x\x1cy é É a b\r\na b" * 3),
            ("fr", "a b c a b c"), ("fr", "a b c a b c"), ("de", "new york new york city"), ("", "p q p q")]
    for top in (2000, 2):
        assert found(spark, rows, least=2, top=top) == sorted(brute(rows, 2, top=top))


def test_empty_table(spark):
    assert found(spark, []) == []


def test_exact_beyond_64_bits(spark):
    """Scores of one long run: 1000 * a * n over l * r."""
    rows = [("en", "u v " * 50_000)]
    assert found(spark, rows, least=100) == sorted(brute(rows, 100))


@pytest.mark.parametrize("seed", range(4))
def test_extension_counts_every_phrase(seed):
    """All intervals of a random text, extended from the words on, count what scanning counts."""
    rng = np.random.default_rng(seed)
    s = np.concatenate([[0], rng.integers(0, 4, 300), [0]])
    forward, backward = P.transforms(s)
    counts = np.bincount(s)
    f = (np.cumsum(counts) - counts)[1:]
    words, r, n = [(w,) for w in range(1, len(counts))], f, counts[1:]
    for length in range(2, 6):
        parent, symbol, f, r, n = P.extend(forward, backward, f, r, n)
        words = [words[p] + (int(c),) for p, c in zip(parent, symbol, strict=True)]
        plain = Counter(tuple(s[i:i + length].tolist()) for i in range(len(s) - length + 1))
        assert dict(zip(words, n.tolist(), strict=True)) == {k: v for k, v in plain.items() if 0 not in k}


def test_phrases_without_alive_ends_are_not_extended():
    s = np.array([0, 1, 2, 3, 0, 1, 2, 0])
    forward, backward = P.transforms(s)
    counts = np.bincount(s)
    start = np.cumsum(counts) - counts
    parent, symbol, *_, n = P.extend(forward, backward, start[1:3], start[1:3], counts[1:3])
    assert [(int(p) + 1, int(c), int(k)) for p, c, k in zip(parent, symbol, n, strict=True)] == [(1, 2, 2)]


def test_late_words_are_located():
    """Positions times ids pass 32 bits, with ids as Spark's integers."""
    s = np.concatenate([[0], np.arange(1, 60_001), [60_000, 60_000, 59_999, 0]])
    forward, backward = P.transforms(s)
    counts = np.bincount(s)
    orders = [np.argsort(t, kind="stable") for t in (forward, backward)]
    words = np.array([[60_000, 59_999, 5], [60_000, 60_000, 6]], np.int32)
    assert P.locate(*orders, forward, backward, np.cumsum(counts) - counts, counts, words)[2].tolist() == [2, 1, 1]


def test_workers_get_few_shards_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 6, 1, 1).select(F.repeat(F.lit("x"), P.BATCH_BYTES).alias("v"))
    before = spark.conf.get(session.ARROW_BYTES)
    with session.arrow_batches(spark, P.BATCH_BYTES):
        assert max(r.n for r in rows.mapInArrow(sizes, "n bigint").collect()) <= 2
    assert spark.conf.get(session.ARROW_BYTES) == before
