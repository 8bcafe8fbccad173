"""Summaries kept up batch by batch equal those of all rows at once, and a tick does not read the history."""

import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetlake.sources import fixtures
from packetlake.streaming import feed as feeds
from packetlake.streaming.feed import Feed, process_batch
from packetlake.streaming.store import PacketStore
from packetlake.streaming.summaries import Summary
from tests.conftest import SF001

WIDE = Summary({"n": ("count", "length"), "total": ("sum", "length"), "mean": ("avg", "length"), "least": ("min", "length"), "most": ("max", "pname")},
               keys=("dst_port",), where="length > 3")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([80, 443, None]), st.one_of(st.none(), st.integers(-2**62, 2**62)), st.sampled_from("abc")), max_size=40),
       st.lists(st.integers(0, 40), max_size=4))
def test_merged_partials_are_the_whole(spark, rows, cuts):
    df = lambda some: spark.createDataFrame(some, "dst_port bigint, length bigint, pname string")
    edges = [0, *sorted(cuts), len(rows)]
    for summary in (WIDE, Summary({k: WIDE.measures[k] for k in ("n", "mean", "most")})):
        state = None
        for a, b in zip(edges, edges[1:], strict=False):
            part = summary.partial(df(rows[a:b]))
            state = part if state is None else summary.merge(state, part)
        assert sorted(map(str, summary.finish(state).collect())) == sorted(map(str, summary.over(df(rows)).collect()))


def test_only_mergeable_measures():
    with pytest.raises(ValueError, match="can't be merged"):
        Summary({"m": ("median", "length")})


def batches(spark, n):
    raw = fixtures.raw_events(spark, SF001)
    return [raw.where(F.col("recv_seq") % n == i) for i in range(n)]


def test_feed_delivers_what_full_evaluation_does(spark, tmp_path):
    """Rows that qualify late, a feed that was away for a batch, and a replayed batch."""
    store = PacketStore(str(tmp_path / "store"))
    full = Feed(store, "full", "SELECT * FROM packets WHERE length > (SELECT avg(length) FROM packets)", spark=spark)
    kept = Feed(store, "kept", "SELECT * FROM packets WHERE length > (SELECT mean FROM totals)", spark=spark,
                summaries={"totals": Summary({"mean": ("avg", "length")})})
    ports = "SELECT p.* FROM packets p JOIN (SELECT dst_port AS d, {} AS m FROM {} GROUP BY dst_port{}) s ON p.dst_port = s.d WHERE p.length > s.m"
    by_port = Feed(store, "by_port", ports.format("avg(length)", "packets", ""), spark=spark)
    by_port_kept = Feed(store, "by_port_kept", ports.format("max(mean)", "ports", ""), spark=spark,
                        summaries={"ports": Summary({"mean": ("avg", "length")}, keys=("dst_port",))})
    for i, batch in enumerate(batches(spark, 4)):
        here = [full, kept, by_port, by_port_kept] if i != 2 else []
        process_batch(store, here, batch, i)
        if i == 1:
            process_batch(store, here, batch, i)
    rows = lambda f: sorted(map(tuple, f.delivered(spark).select("batch_id", "index").collect()))
    assert rows(full) == rows(kept) != [] and rows(by_port) == rows(by_port_kept) != []


def test_a_tick_reads_its_batch_and_the_state(spark, tmp_path, monkeypatch):
    store = PacketStore(str(tmp_path / "store"))
    kept = Feed(store, "kept", "length > (SELECT mean FROM totals)", spark=spark, summaries={"totals": Summary({"mean": ("avg", "length")})})
    read = []
    monkeypatch.setattr(PacketStore, "packets", lambda *a, **k: pytest.fail("a tick read the history"))
    above = feeds.Feed._above
    monkeypatch.setattr(feeds.Feed, "_above", lambda *a: read.append(above(*a)) or read[-1])
    for i, batch in enumerate(batches(spark, 6)):
        process_batch(store, [kept], batch, i)
    assert all(len({os.path.dirname(f) for f in df.inputFiles()}) <= 2 for df in read[1:])


def test_summaries_are_checked_with_the_statement(spark, tmp_path):
    store = PacketStore(str(tmp_path / "store"))
    with pytest.raises(ValueError, match="refused"):
        Feed(store, "x", "length > (SELECT mean FROM totals)", spark=spark)
    with pytest.raises(ValueError, match="refused"):
        Feed(store, "x", "length > (SELECT nothing FROM totals)", spark=spark, summaries={"totals": Summary({"mean": ("avg", "length")})})
