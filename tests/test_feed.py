"""The capture query appends, numbers and feeds."""

import os

import pytest
from pyspark.sql import functions as F

from packetlake.sources import fixtures, frames as FR
from packetlake.streaming.feed import Feed, compact_deliveries, process_batch, start_capture
from packetlake.streaming.store import PacketStore
from tests.conftest import SF001


def _write_frames(spark, frames_dir, lo, hi, name):
    raw = fixtures.raw_events(spark, SF001).filter((F.col("recv_seq") >= lo) & (F.col("recv_seq") <= hi))
    FR.encode_frames(FR.events_as_frame_rows(raw)).coalesce(1).write.parquet(os.path.join(frames_dir, name))


def _stream(spark, frames_dir):
    return (spark.readStream.schema("recv_seq bigint, frame binary").option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(frames_dir))


def _run(spark, root, feeds, frames_dir):
    q = start_capture(_stream(spark, frames_dir), PacketStore(root), feeds, os.path.join(root, "_ckpt"),
                      available_now=True)
    q.awaitTermination()


def _by_batch(spark, feed):
    rows = feed.delivered(spark).select("batch_id", "index").collect()
    out = {}
    for r in rows:
        out.setdefault(r["batch_id"], []).append(r["index"])
    return [sorted(v) for _, v in sorted(out.items())]


@pytest.fixture
def two_batches(spark, tmp_path):
    frames_dir = str(tmp_path / "frames")
    _write_frames(spark, frames_dir, 0, 3, "a")
    _write_frames(spark, frames_dir, 4, 9, "b")
    return str(tmp_path / "store"), frames_dir


def test_plain_feed_and_store(spark, two_batches):
    root, frames_dir = two_batches
    store = PacketStore(root)
    plain, zero = Feed(store, "plain"), Feed(store, "zero", start_after=0)
    _run(spark, root, [plain, zero], frames_dir)
    assert _by_batch(spark, plain) == [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9]]
    assert _by_batch(spark, zero) == [[1, 2, 3], [4, 5, 6, 7, 8, 9]]
    stored = store.packets(spark).orderBy("index").collect()
    assert [r["index"] for r in stored] == list(range(10))
    assert plain.cursor(spark) == 9
    ticks = [tuple(r) for r in plain.ticks(spark).orderBy("batch_id").collect()]
    assert ticks == [(0, 4, 3), (1, 6, 9)]


def test_condition_and_full_sql_feeds(spark, two_batches):
    root, frames_dir = two_batches
    store = PacketStore(root)
    cond = Feed(store, "cond", "index IN (2, 7)")
    first3 = Feed(store, "first3", "SELECT * FROM packets WHERE index < 3")
    late = Feed(store, "late", "SELECT * FROM packets WHERE index = 2 OR "
                               "(index = 1 AND (SELECT max(index) FROM packets) >= 5)")
    dup = Feed(store, "dup", "SELECT * FROM packets WHERE index < 5 UNION ALL "
                             "SELECT * FROM packets WHERE index > 2 AND index < 7")
    _run(spark, root, [cond, first3, late, dup], frames_dir)
    assert _by_batch(spark, cond) == [[2], [7]]
    assert [tuple(r) for r in cond.ticks(spark).orderBy("batch_id").collect()] == [(0, 1, 2), (1, 1, 7)]
    assert _by_batch(spark, first3) == [[0, 1, 2]]
    assert _by_batch(spark, late) == [[2]]
    assert _by_batch(spark, dup) == [[0, 1, 2, 3, 3], [4, 4, 5, 6]]


def test_stop_and_start_with_another_filter(spark, tmp_path):
    frames_dir, root = str(tmp_path / "frames"), str(tmp_path / "store")
    store = PacketStore(root)
    _write_frames(spark, frames_dir, 0, 3, "a")
    first = Feed(store, "first")
    _run(spark, root, [first], frames_dir)
    _write_frames(spark, frames_dir, 4, 9, "b")
    second = Feed(store, "second", "index % 2 = 0", start_after=first.cursor(spark))
    _run(spark, root, [second], frames_dir)
    assert _by_batch(spark, first) == [[0, 1, 2, 3]]
    assert _by_batch(spark, second) == [[4, 6, 8]]


def test_late_feed_reads_history(spark, two_batches):
    root, frames_dir = two_batches
    store = PacketStore(root)
    early = Feed(store, "early", "index < 2 OR index = 8")
    _run(spark, root, [early], frames_dir)
    late = Feed(store, "late", "index > 5 OR index = 1")
    n, cursor = late.deliver(spark, 1)
    assert (n, cursor) == (5, 9)
    # The early feed's deliveries and cursor for that batch are untouched.
    assert _by_batch(spark, early) == [[0, 1], [8]]
    assert early.cursor(spark) == 8 and late.cursor(spark) == 9
    assert store.next_index(spark, 2) == 10


def test_crash_between_append_and_deliver(spark, two_batches):
    root, frames_dir = two_batches
    store = PacketStore(root)
    feed = Feed(store, "f", "index >= 2")
    failed = []

    def body(batch, batch_id):
        crash = batch_id == 1 and not failed
        if crash:
            failed.append(batch_id)
        process_batch(store, [feed], batch, batch_id, fail_after_append=crash)

    def start():
        return (_stream(spark, frames_dir).writeStream.foreachBatch(body)
                .option("checkpointLocation", os.path.join(root, "_ckpt")).trigger(availableNow=True).start())

    q = start()
    with pytest.raises(Exception):
        q.awaitTermination()
    assert failed == [1]
    start().awaitTermination()
    stored = [r["index"] for r in store.packets(spark).collect()]
    assert sorted(stored) == list(range(10))
    delivered = [r["index"] for r in feed.delivered(spark).collect()]
    assert sorted(delivered) == list(range(2, 10))


def test_side_tables(spark, tmp_path):
    LE, _, _ = FR.message_classes()
    h = LE(); h.heartbeat_payload.count = 2**40; h.heartbeat_payload.message = "hb"
    r = LE(); r.run_log = "started"
    rows = [(0, h.SerializeToString()), (1, r.SerializeToString()), (2, b"\x01")]
    batch = spark.createDataFrame(rows, "recv_seq bigint, frame binary")
    store = PacketStore(str(tmp_path / "s"))
    process_batch(store, [], batch, 0)
    assert [(x["count"], x["message"]) for x in store.side(spark, "heartbeats").collect()] == [(2147483647, "hb")]
    assert [x["log_info"] for x in store.side(spark, "process_logs").collect()] == ["started"]
    from pyspark.sql import types as T

    from packetlake.streaming.store import BATCH_ID, SIDE_SCHEMA, read_partitioned, with_columns
    schema = with_columns(SIDE_SCHEMA, BATCH_ID, T.StructField("kind", T.StringType(), True))
    raw_side = read_partitioned(spark, store.path("side"), schema)
    assert [r["count"] for r in raw_side.filter("kind = 'process_log'").collect()] == [None]
    assert [x["recv_seq"] for x in store.side(spark, "bad_frames").collect()] == [2]
    assert store.packets(spark).count() == 0
    assert store.next_index(spark, 1) == 0


from hypothesis import HealthCheck, given, settings, strategies as st


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cuts=st.lists(st.integers(min_value=1, max_value=29), min_size=1, max_size=3, unique=True))
def test_ticks_add_up_to_one_batch_query(spark, tmp_path_factory, cuts):
    """For any split of the input, the union of all ticks = the batch query."""
    from packetlake.operators.query import condition_filter

    raw = fixtures.raw_events(spark, SF001).filter(F.col("recv_seq") < 30).cache()
    root = str(tmp_path_factory.mktemp("split"))
    store = PacketStore(root)
    cond = "dst_port IN (80, 443) OR is_binary = true"
    feed = Feed(store, "f", cond)
    bounds = [0] + sorted(cuts) + [30]
    for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        batch = raw.filter((F.col("recv_seq") >= lo) & (F.col("recv_seq") < hi))
        process_batch(store, [feed], batch, b)
    got = sorted(r["index"] for r in feed.delivered(spark).collect())
    want = sorted(r["index"] for r in condition_filter(fixtures.packets(spark, SF001), cond).filter("index < 30").collect())
    assert got == want
    raw.unpersist()


def test_restart_after_failure(spark, two_batches):
    from packetlake.streaming.feed import run_with_restarts

    root, frames_dir = two_batches
    store = PacketStore(root)
    feed = Feed(store, "f")
    calls = []

    def body(batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("lost the source")
        process_batch(store, [feed], batch, batch_id)

    def start():
        return (_stream(spark, frames_dir).writeStream.foreachBatch(body)
                .option("checkpointLocation", os.path.join(root, "_ckpt")).trigger(availableNow=True).start())

    run_with_restarts(start, max_restarts=2, backoff_s=0.01)
    assert calls == [0, 1, 1]
    assert sorted(r["index"] for r in feed.delivered(spark).collect()) == list(range(10))


def test_native_condition_stream(spark, two_batches):
    """T4: Mode A as a stateless streaming filter over the store's files."""
    from packetlake.streaming.feed import condition_stream

    root, frames_dir = two_batches
    store = PacketStore(root)
    _run(spark, root, [], frames_dir)
    out = os.path.join(root, "native_out")
    q = (condition_stream(spark, store, "index IN (2, 7) OR pname = 'curl'", after=0)
         .writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(root, "_native_ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r["index"] for r in spark.read.parquet(out).collect())
    want = sorted(r["index"] for r in store.packets(spark).filter("(index IN (2, 7) OR pname = 'curl') AND index > 0")
                  .collect())
    assert got == want and 2 in got and 7 in got


def test_processing_time_trigger(spark, two_batches):
    """The capture query on a 300 ms tick, one file per micro-batch."""
    root, frames_dir = two_batches
    store = PacketStore(root)
    feed = Feed(store, "f", "pname = 'curl'")
    q = start_capture(_stream(spark, frames_dir), store, [feed], os.path.join(root, "_ckpt"), tick="300 milliseconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["index"] for r in store.packets(spark).collect()) == list(range(10))
    assert sorted(r["index"] for r in feed.delivered(spark).collect()) == [0, 5]
    assert store.manifest(spark).select("batch_id").distinct().count() == 2


def test_on_deliver_callback(spark, two_batches):
    """Each tick's rows reach the consumer in index order; a failing
    consumer makes the batch run again instead of losing its rows."""
    root, frames_dir = two_batches
    store = PacketStore(root)
    seen, failures = [], []

    def consumer(rows, batch_id):
        got = [r["index"] for r in rows.collect()]
        if batch_id == 1 and not failures:
            failures.append(batch_id)
            raise RuntimeError("consumer down")
        seen.append((batch_id, got))

    feed = Feed(store, "f", "index % 3 = 0", on_deliver=consumer)

    def start():
        return start_capture(_stream(spark, frames_dir), store, [feed], os.path.join(root, "_ckpt"),
                             available_now=True)

    from packetlake.streaming.feed import run_with_restarts
    run_with_restarts(start, max_restarts=2, backoff_s=0.01)
    assert seen == [(0, [0, 3]), (1, [6, 9])]


def test_condition_with_subquery_feed(spark, two_batches):
    root, frames_dir = two_batches
    store = PacketStore(root)
    feed = Feed(store, "latest_curl", "index = (SELECT max(index) FROM packets WHERE pname = 'curl')")
    _run(spark, root, [feed], frames_dir)
    assert _by_batch(spark, feed) == [[0], [5]]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cuts=st.lists(st.integers(min_value=1, max_value=29), min_size=1, max_size=3, unique=True))
def test_row_local_full_sql_equals_history(spark, tmp_path_factory, cuts):
    """A row-local Mode B statement read on new rows only delivers what the
    same statement over the whole history delivers, for any split."""
    raw = fixtures.raw_events(spark, SF001).filter(F.col("recv_seq") < 30).cache()
    sql = ("SELECT * FROM packets WHERE pname = 'curl' UNION "
           "SELECT * FROM packets WHERE dst_port = 8080 OR is_binary = true")
    store = PacketStore(str(tmp_path_factory.mktemp("rowlocal")))
    fast, slow = Feed(store, "fast", sql), Feed(store, "slow", sql)
    assert fast.setting.row_local
    slow.setting.row_local = False
    bounds = [0] + sorted(cuts) + [30]
    for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        process_batch(store, [fast, slow], raw.filter((F.col("recv_seq") >= lo) & (F.col("recv_seq") < hi)), b)
    per_batch = lambda f: sorted((r["batch_id"], r["index"]) for r in f.delivered(spark).collect())
    assert per_batch(fast) == per_batch(slow)
    assert len(per_batch(fast)) > 0
    raw.unpersist()


def test_consolidated_history(spark, tmp_path):
    """History reads after consolidation: same rows, same feed deliveries."""
    frames_dir, root = str(tmp_path / "frames"), str(tmp_path / "store")
    store = PacketStore(root)
    sql = "SELECT * FROM packets WHERE length > (SELECT avg(length) FROM packets)"
    _write_frames(spark, frames_dir, 0, 3, "a")
    feed = Feed(store, "above_avg", sql)
    _run(spark, root, [feed], frames_dir)
    with pytest.raises(ValueError):
        store.consolidate(spark, 5)
    store.consolidate(spark, 0)
    assert store.history(spark)["upto"] == 0
    _write_frames(spark, frames_dir, 4, 9, "b")
    _run(spark, root, [feed], frames_dir)
    assert sorted(r["index"] for r in store.packets(spark, upto_batch=1).collect()) == list(range(10))
    got = _by_batch(spark, feed)

    # The same input without consolidation delivers the same rows.
    frames2, root2 = str(tmp_path / "frames2"), str(tmp_path / "store2")
    store2 = PacketStore(root2)
    _write_frames(spark, frames2, 0, 3, "a")
    feed2 = Feed(store2, "above_avg", sql)
    _run(spark, root2, [feed2], frames2)
    _write_frames(spark, frames2, 4, 9, "b")
    _run(spark, root2, [feed2], frames2)
    assert got == _by_batch(spark, feed2) and got


def test_failing_feed_stops_alone(spark, two_batches):
    """Q13 fixed: a filter that fails on data (not on an empty table) stops its
    own feed; the other feeds and the store go on."""
    root, frames_dir = two_batches
    store = PacketStore(root)
    good = Feed(store, "good", "pname = 'curl'")
    bad = Feed(store, "bad", "dst_port = 'abc'")          # accepted on an empty table
    _run(spark, root, [good, bad], frames_dir)
    assert bad.failure is not None
    assert _by_batch(spark, good) == [[0], [5]]
    assert bad.delivered(spark).count() == 0 and bad.cursor(spark) is None
    assert sorted(r["index"] for r in store.packets(spark).collect()) == list(range(10))


def test_single_failing_feed_does_not_stop_ingest(spark, two_batches):
    root, frames_dir = two_batches
    store = PacketStore(root)
    bad = Feed(store, "bad", "dst_port = 'abc'")
    _run(spark, root, [bad], frames_dir)
    assert bad.failure is not None
    assert store.packets(spark).count() == 10


def _feed_batches(spark, tmp_path, n):
    """``n`` batches of ten events each, as process_batch takes them."""
    raw = fixtures.raw_events(spark, SF001)
    return [raw.filter((F.col("recv_seq") >= 10 * b) & (F.col("recv_seq") < 10 * b + 10)) for b in range(n)]


def _delivered(spark, feed):
    return sorted(r["index"] for r in feed.delivered(spark).collect())


def test_absent_feed_catches_up(spark, tmp_path):
    store = PacketStore(str(tmp_path / "store"))
    always, pausing = Feed(store, "always", "index % 2 = 0"), Feed(store, "pausing", "index % 3 = 0")
    for b, batch in enumerate(_feed_batches(spark, tmp_path, 4)):
        process_batch(store, [always, pausing] if b in (0, 3) else [always], batch, b)
    assert _delivered(spark, pausing) == list(range(0, 40, 3))
    assert _delivered(spark, always) == list(range(0, 40, 2))


def test_failed_consumer_restarted_under_its_name(spark, tmp_path):
    store = PacketStore(str(tmp_path / "store"))
    calls = []

    def healthy(rows, batch_id):
        calls.append(batch_id)

    def failing(rows, batch_id):
        if batch_id == 1:
            raise RuntimeError("consumer down")

    good, bad = Feed(store, "good", on_deliver=healthy), Feed(store, "bad", on_deliver=failing)
    batches = _feed_batches(spark, tmp_path, 4)
    for b in range(3):
        process_batch(store, [good, bad], batches[b], b)
    assert calls == [0, 1, 2]                                  # the healthy consumer once a batch
    assert bad.failure is not None and bad.cursor(spark) == 9
    assert _delivered(spark, bad) == list(range(10))
    again = Feed(store, "bad")
    process_batch(store, [good, again], batches[3], 3)
    assert _delivered(spark, again) == list(range(40))
    assert _delivered(spark, good) == list(range(40))


def test_passing_error_is_retried(spark, tmp_path, monkeypatch):
    store = PacketStore(str(tmp_path / "store"))
    feed = Feed(store, "f", "index % 4 = 1")
    select, broken = feed.select, {1}

    def flaky(spark, batch_id, *rest, **more):
        if batch_id in broken:
            raise OSError("storage is away")
        return select(spark, batch_id, *rest, **more)

    monkeypatch.setattr(feed, "select", flaky)
    for b, batch in enumerate(_feed_batches(spark, tmp_path, 3)):
        process_batch(store, [feed], batch, b)
    assert feed.failure is None
    assert _delivered(spark, feed) == list(range(1, 30, 4))


def test_condition_stream_after_a_replayed_batch(spark, tmp_path):
    from packetlake.streaming.feed import condition_stream

    store, out = PacketStore(str(tmp_path / "store")), str(tmp_path / "out")
    batches = _feed_batches(spark, tmp_path, 2)

    def drain():
        (condition_stream(spark, store, None).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination())

    process_batch(store, [], batches[0], 0)
    drain()
    process_batch(store, [], batches[0], 0)                    # the same batch again
    process_batch(store, [], batches[1], 1)
    drain()
    assert sorted(r["index"] for r in spark.read.parquet(out).collect()) == list(range(20))


def test_plain_feed_reads_one_batch_folder(spark, tmp_path):
    store = PacketStore(str(tmp_path / "store"))
    feed = Feed(store, "f")
    assert feed.setting.row_local
    for b, batch in enumerate(_feed_batches(spark, tmp_path, 2)):
        process_batch(store, [feed], batch, b)
    files = feed.select(spark, 1, 9, history=False).inputFiles()
    assert files and all("batch_id=1" in f for f in files)


@pytest.mark.parametrize("sql", [
    "SELECT index % 5 AS index, * EXCEPT (index) FROM packets",
    "SELECT * FROM packets WHERE rand() < 0.5",
    "SELECT * FROM packets WHERE current_timestamp() > TIMESTAMP '2000-01-01 00:00:00'",
])
def test_statements_that_need_history(spark, sql):
    from packetlake.operators.verify import is_row_local
    from packetlake.schema import PACKET_SCHEMA

    spark.createDataFrame([], PACKET_SCHEMA).createOrReplaceTempView("packets")
    assert is_row_local(spark.sql("SELECT * FROM packets WHERE pid > 3 UNION SELECT * FROM packets"))
    assert not is_row_local(spark.sql(sql))


def test_restarts_go_on_until_stopped():
    import threading

    from packetlake.streaming.feed import run_with_restarts

    stop, started = threading.Event(), []

    class Lost:
        recentProgress = [object()]      # each run completed a batch before it failed

        def awaitTermination(self):
            if len(started) == 7:
                stop.set()
            raise RuntimeError("lost the source")

    def start():
        started.append(1)
        return Lost()

    run_with_restarts(start, max_restarts=2, backoff_s=0.001, stop=stop)
    assert len(started) == 7


def test_history_is_read_by_default_and_consolidated_again(spark, two_batches):
    root, frames_dir = two_batches
    store = PacketStore(root)
    _run(spark, root, [], frames_dir)
    first = store.consolidate(spark, 0)
    assert any(first in f for f in store.packets(spark).inputFiles())
    second = store.consolidate(spark, 0)
    assert second != first and store.history(spark)["path"] == second
    assert sorted(r["index"] for r in store.packets(spark).collect()) == list(range(10))
    store.consolidate(spark, 1)
    assert sorted(r["index"] for r in store.packets(spark).collect()) == list(range(10))


def test_kafka_batches_are_numbered_in_arrival_order(spark, tmp_path):
    store = PacketStore(str(tmp_path / "store"))
    raw = fixtures.raw_events(spark, SF001).filter("recv_seq < 8")
    frames = FR.encode_frames(FR.events_as_frame_rows(raw)).withColumnRenamed("frame", "value")
    kafka = frames.select("value", F.lit("t").alias("topic"), (F.col("recv_seq") % 2).cast("int").alias("partition"),
                          F.call_function("div", F.col("recv_seq"), F.lit(2)).alias("offset"))
    process_batch(store, [], FR.kafka_frames(kafka), 0)
    got = [r["uuid"] for r in store.packets(spark).orderBy("index").collect()]
    assert got == [r["uuid"] for r in raw.orderBy("recv_seq").collect()]


def test_building_the_plans_of_frames_runs_no_job_but_the_measured_join(spark):
    raw = fixtures.raw_events(spark, SF001)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    FR.route_events(FR.decode_frames(FR.encode_frames(FR.events_as_frame_rows(raw))))
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_folded_deliveries(spark, tmp_path):
    """The folded table and the batch folders after it hold each delivered row once, also after folding again and removing."""
    frames_dir, root = str(tmp_path / "frames"), str(tmp_path / "store")
    store = PacketStore(root)
    feeds = [Feed(store, "plain"), Feed(store, "none", "index < 0"), Feed(store, "late", "index >= 4")]
    bounds = [(0, 3), (4, 9), (10, 14)]

    def given():
        return {f.name: _by_batch(spark, f) for f in feeds}

    for batch, (lo, hi) in enumerate(bounds):
        _write_frames(spark, frames_dir, lo, hi, f"part-{batch}")
        _run(spark, root, feeds, frames_dir)
        want = {"plain": [list(range(a, b + 1)) for a, b in bounds[:batch + 1]], "none": [],
                "late": [list(range(a, b + 1)) for a, b in bounds[1:batch + 1]]}
        assert given() == want
        if batch < 2:
            compact_deliveries(spark, store, batch, remove=batch == 1)
            assert given() == want
    assert not os.path.exists(os.path.join(root, "delivered", "batch_id=1"))
    assert [r["index"] for r in feeds[0].delivered_in(spark, 1).collect()] == list(range(4, 10))
    assert [tuple(r) for r in feeds[2].ticks(spark).orderBy("batch_id").collect()] == [(1, 6, 9), (2, 5, 14)]
    assert [tuple(r) for r in store.batches(spark).orderBy("batch_id").collect()] == [(0, 0, 4), (1, 4, 6), (2, 10, 5)]
    assert len([f for f in os.listdir(os.path.join(root, "delivered_history")) if f.startswith("upto=")]) == 1
    with pytest.raises(ValueError):
        feeds[0].deliver(spark, 1)
    with pytest.raises(ValueError):
        compact_deliveries(spark, store, 0)
    with pytest.raises(ValueError):
        compact_deliveries(spark, store, 7)
