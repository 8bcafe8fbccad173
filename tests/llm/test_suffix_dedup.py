"""op10 against every 100-byte string in a dictionary, the suffix array against sorting."""

import hashlib
import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from packetlake.llm import queries, suffix_dedup
from tests.llm.conftest import SF001


@settings(max_examples=400)
@given(st.one_of(st.binary(max_size=60), st.text(alphabet="ab", max_size=80).map(str.encode), st.text(alphabet="abéc\0", max_size=60).map(str.encode)))
def test_suffix_array(data):
    text = bytes(suffix_dedup.SEPARATOR if c > 0xF7 else c for c in data)
    key = lambda i: [-1 if c == suffix_dedup.SEPARATOR else c for c in text[i:]]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=key)


def brute(rows, width=100):
    """Results by looking every string up; rows of (doc_id, text)."""
    last = max((i for i, _ in rows if i is not None), default=0) + 1
    first, out = {}, []
    data = [(last if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, raw in data:
        for s in range(len(raw) - width + 1):
            w = raw[s:s + width]
            first[w] = min(key, first.get(w, key))
    for key, i, raw in data:
        gone, own = bytearray(len(raw)), set()
        for s in range(len(raw) - width + 1):
            w = raw[s:s + width]
            if first[w] < key or w in own:
                gone[s:s + width] = b"\1" * width
            own.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for n in range(len(gone)) if gone[n] and (n == 0 or not gone[n - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op10_suffix_dedup(spark, SF001).collect()), key=str)
    assert got == brute(rows)


def passages(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeé ", k=rnd.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    shared = [text(rnd.randint(10, 40)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [text(rnd.randint(0, 30)) for _ in range(rnd.randint(1, 4))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(shared)
            a, b = sorted(rnd.sample(range(len(p)), 2))
            parts.insert(rnd.randrange(len(parts) + 1), p if rnd.random() < 0.4 else p[a:b])
        rows.append((rnd.randrange(1000) * 100 + i, "".join(parts)))
    base = text(150)
    for i in range(12):
        cut = rnd.randrange(len(base))
        rows.append((200_000 + i, base[:cut] + rnd.choice("xyz") * rnd.randrange(1, 3) + base[cut:]))
    return rows


def test_shared_passages(spark, make_docs):
    for seed in (1, 2):
        rows = passages(seed)
        assert sorted(map(tuple, suffix_dedup.remove_repeats(make_docs(rows)).collect()), key=str) == brute(rows)


def test_blocks_of_long_texts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 257)
    suffix_dedup._powers.cache_clear()
    rows = passages(3)[:40]
    rows.append((7, " ".join(t for _, t in rows[:20])))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 257)
    parts = [suffix_dedup._document_rows(t.encode(), 100) for _, t in rows if len(t.encode()) >= 100]
    assert all(p[4].sum() == len(t.encode()) - 99 for p, t in zip(parts, [t for _, t in rows if len(t.encode()) >= 100], strict=True))
    suffix_dedup._powers.cache_clear()


def test_odd_rows(spark, make_docs):
    line = "The same line of words, long enough to hold a hundred bytes and some more, stands in many documents here. "
    rows = [(None, line), (None, line + "x"), (3, None), (4, ""), (5, line), (2, "start " + line), (6, line * 4), (6, line * 4), (7, "a" * 700),
            (8, "a" * 99), (9, "é" * 90), (10, line[:99]), (11, "b" * 50 + line[:100]), (12, "ab" * 30000), (2, "start " + line)]
    assert sorted(map(tuple, suffix_dedup.remove_repeats(make_docs(rows)).collect()), key=str) == brute(rows)
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


def test_hot_minimizers_are_split_by_their_sides(spark, make_docs, monkeypatch):
    """A phrase in many surroundings: groups of its sides find what one group of its minimizer finds."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS_TOGETHER", 2)
    draw = random.Random(11)
    word = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    phrase, heads, tails = word(60), [word(40) for _ in range(5)], [word(40) for _ in range(5)]
    rows = [(i, word(draw.randrange(30)) + draw.choice(heads)[draw.randrange(20):] + phrase + draw.choice(tails)[:draw.randrange(41)]
             + word(draw.randrange(30))) for i in range(120)]
    rows += passages(3)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = [tuple(r) for r in suffix_dedup.remove_repeats(make_docs(rows)).collect()]
    assert sorted(found, key=str) == brute(rows)
    assert sum(r[2] for r in found) > 0


def test_rows_without_an_id_are_told_apart_by_the_whole_hash(spark, make_docs):
    """Two texts that agree on 25 bits of their hash: the repeat of one is not taken out of the other."""
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, front, short = noise(120), noise(400), noise(130)
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & ((1 << 25) - 1)
    long_texts = {low(t): t for t in (f"{i} {front}{line}" for i in range(30_000))}
    one, other = next((long_texts[low(t)], t) for t in (f"{i} {short}" for i in range(30_000)) if low(t) in long_texts)
    rows = [(1, line), (None, one), (None, other)]
    assert sorted(map(tuple, suffix_dedup.remove_repeats(make_docs(rows)).collect()), key=str) == brute(rows)
