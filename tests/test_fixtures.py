"""The raw events and the stored table when the documents are too big to broadcast."""

import pyarrow.parquet as pq
import pytest

from packetlake.operators import joins
from packetlake.plans import streams
from packetlake.session import FREE_SHUFFLES, shuffles_freed
from packetlake.sources import fixtures
from tests.conftest import SF001


@pytest.fixture
def never_fits(monkeypatch):
    for module in (joins, fixtures):
        monkeypatch.setattr(module, "fits", lambda *_: False)


def test_only_events_with_a_document_are_shuffled(spark, never_fits, request):
    """The other kinds join the result by a union, and the rows are those of the broadcast join."""
    split = fixtures.raw_events(spark, SF001)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.index("Union") < plan.index("Join")
    got = sorted(map(tuple, split.collect()))
    request.getfixturevalue("monkeypatch").undo()
    assert got == sorted(map(tuple, fixtures.raw_events(spark, SF001).collect())) and len(got) == 1000


def test_payload_tables_are_compressed(spark):
    path = fixtures.packets_path(spark, SF001).removeprefix("file:")
    files = [f for f in pq.ParquetDataset(path).files]
    assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)


def test_ticks_are_derived_at_once(spark):
    """Each event and its extra frame lie in one tick; all ticks come of one plan."""
    rows = streams.tick_frames(spark, SF001).select("recv_seq", "tick").collect()
    assert sorted(r.recv_seq for r in rows) == sorted([2 * e for e in range(1000)] + [2 * e + 1 for e in range(1000) if e % 10 < 3])
    assert all(r.tick == r.recv_seq // 2 * streams.TICKS // 1000 for r in rows)


def test_shuffles_are_freed_inside_only(spark):
    before = spark.conf.get(FREE_SHUFFLES)
    with shuffles_freed(spark):
        assert spark.conf.get(FREE_SHUFFLES) == "true"
    assert spark.conf.get(FREE_SHUFFLES) == before


def test_equal_long_texts_are_stored_side_by_side(spark):
    texts = ["a" * 300, "b" * 300, "c" * 300, "short"]
    rows = spark.createDataFrame([(i, texts[i % 4], len(texts[i % 4])) for i in range(40)], "index bigint, payload_utf8 string, length bigint").coalesce(1)
    kept = [(r[0], r[1]) for r in fixtures.laid_out(rows, False).collect()]
    assert [i for i, t in kept if t == "short"] == [i for i, _ in kept[:10]] == list(range(3, 40, 4))
    assert sum(a != b for (_, a), (_, b) in zip(kept, kept[1:], strict=False)) == 3
    assert [r[0] for r in fixtures.laid_out(rows, True).collect()] == list(range(40))


def test_table_is_written_in_document_parts(spark, never_fits, tmp_path, monkeypatch):
    """Each part shuffles its share of the documents only; together they are the whole table, each event once."""
    parts = [fixtures.raw_events(spark, SF001, part=p) for p in range(fixtures.DOCUMENT_PARTS)]
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 1000 and all(0 < n < 100 for n in sizes[1:])
    got = sorted(tuple(r) for p in parts for r in p.collect())
    written = []
    monkeypatch.setattr(fixtures, "checkpoint_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(fixtures, "shuffles_freed", lambda s: written.append(s) or shuffles_freed(s))
    stored = sorted(r["index"] for r in fixtures.packets_table(spark, SF001).select("index").collect())
    assert stored == list(range(1000)) and len(written) == fixtures.DOCUMENT_PARTS
    monkeypatch.undo()
    assert got == sorted(map(tuple, fixtures.raw_events(spark, SF001).collect()))
