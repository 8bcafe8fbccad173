"""op12 against a Python version of the samples, and the collision rate against generalised Jaccard similarity."""

import hashlib
import math
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from packetlake.llm import queries
from packetlake.llm import weighted_sampling as W
from tests.llm.conftest import SF001

MASK = (1 << 64) - 1
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return Counter([w for w in text.split(" ") if w] or [""])


def plain_signature(text, samples=W.SAMPLES):
    terms = [(xxhash.xxh64(w.encode(), seed=42).intdigest(), math.log(n)) for w, n in words(text).items()]
    out = ""
    for j in range(samples):
        best = None
        for term, weight in terms:
            h, g, m = (xxhash.xxh64(struct.pack("<Q", term ^ ((3 * j + i + 1) * 0x9E3779B97F4A7C15 & MASK)), seed=42).intdigest() for i in range(3))
            high, low = (lambda x: ((x >> 32) + 0.5) / 2**32), (lambda x: ((x & 0xFFFFFFFF) + 0.5) / 2**32)
            r = -math.log(high(h) * low(h))
            t = math.floor(weight / r + high(m))
            value = math.log(-math.log(high(g) * low(g))) - r * (t - high(m) + 1)
            packed = math.floor((value + W.LOWEST) * W.SCALE) << 32 | ((m ^ t << 8) & 0xFFFFFFFF)
            best = packed if best is None else min(best, packed)
        out += f"{best & 0xFFFF:04x}"
    return out


def brute(rows, samples=W.SAMPLES, every=1):
    """(doc_id, n_chars, sha256, fingerprint, edited fingerprint, near edited, near next) of every n-th of (doc_id, text) rows, in their order."""
    share = lambda a, b: sum(a[i:i + 4] == b[i:i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)
    texts, out = [t or "" for _, t in rows], []
    for i, (doc_id, _) in list(enumerate(rows))[::every]:
        text, after = texts[i], texts[(i + 1) % len(rows)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = (plain_signature(t, samples) for t in (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, share(a, b), share(a, c)))
    return out


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: tuple(r) for r in queries.op12_weighted_sampling(spark, SF001).collect()}
    assert len(got) == len(rows)
    want = brute(rows, every=10)
    for w in want:
        g = got[w[0]]
        assert g[:3] == w[:3] and all(0 <= x <= 1 for x in g[5:])
    # Logarithms of the two runtimes may differ in their last bit: all but a few samples are the same.
    pairs = [(g, w) for w in want for g, w in ((got[w[0]][3], w[3]), (got[w[0]][4], w[4]))]
    differ = sum(a[i:i + 4] != b[i:i + 4] for a, b in pairs for i in range(0, len(a), 4))
    assert differ <= len(pairs) // 100
    # The share of equal samples is the generalised Jaccard similarity, to the error of 64 samples.
    off = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = words(text), words(after)
        off.append(got[i][6] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(off) / len(off)) < 0.01 and math.sqrt(sum(x * x for x in off) / len(off)) < 0.06


def test_odd_rows(spark, make_docs):
    rows = [(None, "z"), (1, "a b b"), (1, "a b b"), (1, "a b b"), (2, ""), (3, None), (4, " \t\n"), (5, "é 𝄞 x" * 300), (6, "word " * 20_000), (9, "a b b")]
    got = W.fingerprints(make_docs(rows), samples=8).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 8)))
    by_text = {}
    for r in got:
        by_text.setdefault({None: "z", 1: "abb", 2: "", 3: "", 4: " ", 9: "abb"}.get(r.doc_id, r.doc_id), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == by_text[" "]


def test_one_or_no_document(spark, make_docs):
    assert W.fingerprints(make_docs([]), samples=8).count() == 0
    (r,) = W.fingerprints(make_docs([(7, "abcdef")]), samples=8).collect()
    assert (r.doc_id, r.n_chars, r.near_next, r.edited_sha256) == (7, 6, 1.0, hashlib.sha256(b"abcabc").hexdigest())


def test_collision_rate(spark):
    """256 samples of weighted words agree as often as the generalised Jaccard similarity says."""
    pairs = [("x " * 9 + "y", "x " * 3 + "y"), ("p q r s t " * 4, "p q r s t"), ("u v w", "u v z")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t for pair in pairs for t in pair)], "k int, text string")
    found = [r.signature for r in W.signatures(df, ["k"], samples=256).orderBy("k").collect()]
    for (a, b), one, two in zip(pairs, found[::2], found[1::2], strict=True):
        x, y = words(a), words(b)
        want = sum((x & y).values()) / sum((x | y).values())
        got = sum(one[i:i + 4] == two[i:i + 4] for i in range(0, len(one), 4)) / 256
        assert abs(got - want) < 4 * math.sqrt(want * (1 - want) / 256) + 0.01


def test_known_terms_change_nothing(spark, make_docs, monkeypatch):
    """The table of frequent words saves work only."""
    rows = [(i, f"a a b c{i % 3} d{i}") for i in range(30)]
    one = sorted(map(tuple, W.fingerprints(make_docs(rows), samples=8).collect()))
    monkeypatch.setattr(W, "KNOWN_TERMS", 1)
    assert one == sorted(map(tuple, W.fingerprints(make_docs(rows), samples=8).collect())) == sorted(brute(rows, 8))


def test_native(spark, make_docs):
    plan = W.fingerprints(make_docs([(1, "a"), (2, "b")]), samples=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bound_changes_nothing(spark, make_docs, monkeypatch):
    """Texts whose samples the bound does not settle are sampled in full; values are left out at all only with a bound."""
    rows = [(i, " ".join(f"w{i}x{k % 40}" for k in range(60 + i))) for i in range(6)]
    monkeypatch.setattr(W, "KNOWN_TERMS", 1)
    settled = []
    for draws in (1.0, 24.0):
        monkeypatch.setattr(W, "DRAWS", draws)
        monkeypatch.setattr(W, "_below", lambda v, n, f=W._below, seen=settled: seen.append(1) or f(v, n))
        assert sorted(map(tuple, W.fingerprints(make_docs(rows), samples=8).collect())) == sorted(brute(rows, 8))
    assert settled
    terms = spark.range(1000).select(F.xxhash64("id").alias("t"))
    asked = terms.where(W.may_be_least(F.col("t"), F.lit(1), F.lit(1000), 0)).count()
    assert 24 <= asked < 400


def test_plan_of_the_samples_is_small(spark):
    texts = spark.createDataFrame([(1, "a b c a", "a b d")], "id bigint, text string, edited string")
    known = W.known_samples(texts)
    plan = W._pair_signatures(texts, ["id"], known, W.SAMPLES, bounded=True)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") < 8 * W.SAMPLES


def test_code_of_the_samples_is_short(spark):
    """The JVM interprets methods of more than 8,000 bytes, and Spark makes no code for rows of more than 100 columns."""
    texts = spark.createDataFrame([(1, "a b c a", "a b d")], "id bigint, text string, edited string")
    known = W.known_samples(texts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = W._pair_signatures(texts, ["id"], known, W.SAMPLES, bounded=True)._jdf.queryExecution()
        made = query.debug().codegenToSeq()
        assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000
        nodes = [query.optimizedPlan()]
        for node in nodes:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert max(node.output().size() for node in nodes) <= int(spark.conf.get("spark.sql.codegen.maxFields", "100"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
