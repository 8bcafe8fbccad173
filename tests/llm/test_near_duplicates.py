"""op1 against a brute-force fingerprint and all-pairs components."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from packetlake.llm import queries, simhash_bktree
from packetlake.llm.components import components
from tests.llm.conftest import SF001

M = (1 << 64) - 1


def brute_print(text):
    import re

    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, radius=2):
    """{code: smallest code of its component} over all pairs."""
    codes, label = sorted(set(codes)), {c: c for c in codes}
    again = True
    while again:
        again = False
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], again = label[b], True
    return label


def check(rows, texts):
    prints = [(i, brute_print(t)) for i, t in texts]
    label = brute_components([f for _, f in prints])
    first = {}
    for i, f in prints:
        if i is not None:
            first[label[f]] = min(i, first.get(label[f], i))
    assert sorted(map(tuple, rows), key=str) == sorted(((i, f"{f:016x}", first.get(label[f])) for i, f in prints), key=str)


def test_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    check(queries.op1_simhash_bktree(spark, SF001).collect(), texts)


def test_odd_rows(spark, make_docs):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "oNE"), (5, "one"), (6, "a b"), (7, "a b c"), (8, "É é"), (9, "x\x85y z"),
             (None, base), (11, base), (10, base + " end"), (12, base + " fin"), (13, "z " * 40000), (None, "alone")]
    found = simhash_bktree.near_duplicates(make_docs(texts))
    check(found.select("doc_id", simhash_bktree.hex_code("fp"), "component_id").collect(), texts)
    assert simhash_bktree.near_duplicates(make_docs([])).count() == 0


def clustered(n, seed, bits=6):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(max(1, n // 60))]
    codes = set()
    while len(codes) < n:
        c = rnd.choice(centres)
        for _ in range(rnd.randrange(bits)):
            c ^= 1 << rnd.randrange(64)
        codes.add(c)
    return sorted(codes)


@pytest.mark.parametrize("limit", [2048, 3])
def test_links_connect_what_lies_within_the_radius(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash_bktree, "SHARD_ROWS", limit)    # 3: shards are split down to the last level
    codes = clustered(400, 2)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash_bktree.fingerprint_links(spark.createDataFrame([(c,) for c in signed], "fp bigint"))
    label = brute_components(codes)
    got = {r.node & M: r.root for r in components(links).collect()}
    groups, want = {}, {}
    for c in codes:
        groups.setdefault(got.get(c, ("own", c)), set()).add(c)
        want.setdefault(label[c], set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@given(st.lists(st.integers(0, M), min_size=1, max_size=40, unique=True), st.integers(0, M), st.integers(0, 64))
def test_tree_finds_all_within_the_radius(codes, code, radius):
    tree = simhash_bktree.BKTree()
    for c in codes:
        tree.add(c)
    assert sorted(tree.within(code, radius)) == [i for i, c in enumerate(codes) if (c ^ code).bit_count() <= radius]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(200, 200), (-5, 300)]
    rows = {r.node: r.root for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert rows == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 130)} | {-5: -5, 300: -5}
