"""op9 and op7 against plain Python."""

import random
from collections import defaultdict

import pytest

from packetlake.llm import mixing, queries, url_filter
from tests.llm.conftest import SF001


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in queries.URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


URLS = [None, "", "x", "://", "http://", "http://net", "http://net/", "http://a.net/x", "http://internet/", "HTTP://WWW.Example.NET/en/x?y#z",
        "http://example.net/en", "http://example.com/de/", "http://example.com?/de/", "https://a.b.example.com/de/1#q", "http://x.org/fr/",
        "http://.net/", "http://net./", "http://org/fr/a/fr/", "a://b://c.net/", "http://É.net/", "http://x.net:80/", "http://a.net\n/x",
        "http://" + "a." * 20000 + "net/" + "p" * 50000, "http://a.net/x"]


def test_urls(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "h"), (3, "http://a.net/", "h")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string").selectExpr("*", "1 AS path", "2 AS rule", "3 AS word")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=str)
    assert got == sorted(((i, *judge(u)) for i, u, _ in rows), key=str)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    none = url_filter.judge_urls(pages, rules.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}


def test_many_rules_pass_the_bloom_filter(spark):
    rnd = random.Random(3)
    rules = [("block", f"h{i}.t{i % 7}", "/" + "p" * (i % 5)) for i in range(500)] + [("allow", "t1", "/pp")]
    urls = [f"http://{rnd.choice(['', 'x.'])}h{rnd.randrange(900)}.t{rnd.randrange(7)}/{'p' * rnd.randrange(7)}" for _ in range(800)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(
        pages, spark.createDataFrame(rules, "action string, host string, path string")).collect()}
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == ((max(fits)[2], max(fits)[3]) if fits else (None, "allow"))


def targets(totals):
    """{source: target} by resharing the excess until none is above its cap."""
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, whole, out = set(names), float(sum(totals.values())), {}
    while left:
        each = (whole - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if each * weight[s] >= 3 * totals[s]}
        if not over:
            out |= {s: each * weight[s] for s in left}
            break
        out |= {s: 3.0 * totals[s] for s in over}
        left -= over
    return out


def check_mix(rows, near):
    totals, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        totals[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = targets(totals)
    for r in rows:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source])
    for s in totals:
        assert abs(taken[s] - want[s]) <= near * want[s] + 3
    return taken


def test_mix_of_a_table(spark):
    rows = queries.op7_source_mixing(spark, SF001).collect()
    sizes = {r.doc_id: len(r.text.encode().split()) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in rows} == sizes
    check_mix(rows, 0.005)
    again = queries.op7_source_mixing(spark, SF001).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_odd_rows(spark, make_docs):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randrange(60), rnd.choice(["a", "a", "a", "b", "é", None, ""])) for i in range(300)]
    rows += [(None, "x y z", "a"), (5, "x y", "b"), (5, "x y", "b"), (5, "x y", "b"), (6, None, "only empty"), (7, "v " * 30000, "long")]
    docs, parts = mixing.mix(make_docs(rows))
    out = mixing.taken_words(docs, parts).collect()
    assert len(out) == len(rows)
    check_mix(out, 0.01)


def test_mix_of_an_empty_table(spark, make_docs):
    docs, parts = mixing.mix(make_docs([]))
    assert mixing.taken_words(docs, parts).count() == 0 and parts.count() == 0
    docs, parts = mixing.mix(make_docs([(1, ""), (2, None)]))
    assert [r.taken for r in mixing.taken_words(docs, parts).collect()] == [0, 0]


def test_small_sources_in_large_blocks(spark, make_docs, monkeypatch):
    """Blocks of a large corpus: sources of less than a block are taken to their targets, too."""
    monkeypatch.setattr(mixing, "block_words", lambda total, sources: mixing.MAX_BLOCK_WORDS)
    rows = [(i, "w " * 400, "e") for i in range(500)] + [(1000 + i, "w " * 50, "a") for i in range(6)]
    rows += [(2000 + i, "w " * 50, "c") for i in range(10)] + [(3000 + i, "w " * 50, None) for i in range(20)] + [(4000, "w", "d")]
    docs, parts = mixing.mix(make_docs(rows))
    taken = check_mix(mixing.taken_words(docs, parts).collect(), 0.0)
    assert (taken["a"], taken["c"], taken[None], taken["d"]) == (900, 1500, 3000, 3)
    slots = parts.select("slot", "source").distinct()
    assert slots.count() == slots.select("slot").distinct().count()


def test_slots_decide_the_order(spark, make_docs, monkeypatch):
    """Any run of slots from the start holds each source near its share; other points give another order."""
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randrange(1, 80), rnd.choice("abcd")) for i in range(400)]

    def order(docs):
        documents, parts = mixing.mix(docs)
        slots = sorted({(r.slot, r.source) for r in parts.select("slot", "source").distinct().collect()})
        target = {r.source: r.target for r in documents.select("source", "target").distinct().collect()}
        return slots, target, {r.doc_id: [x.slot for x in r.rounds] for r in mixing.taken_words(documents, parts).collect()}

    slots, target, first = order(make_docs(rows))
    whole, seen = sum(target.values()), defaultdict(int)
    for n, (_, source) in enumerate(slots, 1):
        seen[source] += 1
        if n <= 0.95 * len(slots):
            assert all(abs(seen[s] - n * target[s] / whole) <= 6 for s in target)
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)
    other, _, late = order(make_docs(rows))
    assert other != slots and late != first


def test_pipeline_copies_stand_in_slot_order(spark, make_docs):
    from packetlake.llm import stages

    rows = [(i, f"w{i} " * (1 + i % 7), "ab"[i % 2]) for i in range(120)] + [(500, "", "a"), (501, None, "b")]
    docs = make_docs(rows)
    documents, parts = mixing.mix(docs)
    slots = {r.doc_id: [x.slot for x in r.rounds] for r in mixing.taken_words(documents, parts).collect()}
    kept, seen, last = [r.doc_id for r in stages.mix_sources(spark, docs, "").collect()], defaultdict(int), -1
    assert {500, 501} <= set(kept)
    for i in kept:
        at = slots[i][min(seen[i], len(slots[i]) - 1)] if slots[i] else -1
        seen[i] += 1
        assert at >= last
        last = at
