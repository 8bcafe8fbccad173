"""Frames decoded and routed on executors; bad frames quarantined."""

from pyspark.sql import functions as F

from packetlake.operators.normalise import events_to_packets
from packetlake.sources import fixtures, frames as FR
from tests.conftest import SF001


def _frames(spark):
    LE, _, _ = FR.message_classes()
    e = LE(); e.log_type = 0; e.event_payload.pname = "curl"; e.event_payload.pid = 2**40
    e.event_payload.payload = b"GET /"; e.event_payload.length = 5
    d = LE(); d.event_payload.SetInParent()
    h = LE(); h.heartbeat_payload.count = 2**40; h.heartbeat_payload.message = "hb"
    r = LE(); r.run_log = ""
    bad = bytearray(e.SerializeToString()); bad[bad.index(b"curl")] = 0xFF
    rows = [(0, e.SerializeToString()), (1, d.SerializeToString()), (2, h.SerializeToString()),
            (3, r.SerializeToString()), (4, b""), (5, b"\xff\xff\xff"), (6, bytes(bad)), (7, None)]
    return spark.createDataFrame(rows, "recv_seq bigint, frame binary")


def test_routes(spark):
    dec = FR.decode_frames(_frames(spark)).cache()
    ev = FR.route_events(dec).orderBy("recv_seq").collect()
    assert [r.recv_seq for r in ev] == [0, 1]
    assert ev[0].pname == "curl" and ev[1].pname == "" and ev[1].pid == 0
    pk = events_to_packets(FR.route_events(dec), index="recv_seq").orderBy("index").collect()
    assert pk[0].pid == 2147483647 and pk[0].payload_utf8 == "GET /"
    from packetlake.operators.normalise import normalise_heartbeats
    hb = normalise_heartbeats(FR.route_heartbeats(dec)).collect()
    assert [(r["count"], r["message"]) for r in hb] == [(2147483647, "hb")]
    assert [r.log_info for r in FR.route_process_logs(dec).collect()] == [""]
    bad = {r.recv_seq: r for r in FR.route_bad_frames(dec).collect()}
    assert sorted(bad) == [4, 5, 6]
    assert bad[4].error == FR.MISSING_PAYLOAD and bad[4].n_bytes == 0
    assert bad[5].error.startswith("decode error") and bad[6].error.startswith("decode error")
    assert dec.filter(F.col("recv_seq") == 7).count() == 0  # not a binary frame: ignored
    dec.unpersist()


def test_round_trip_of_fixture_events(spark):
    raw = fixtures.raw_events(spark, SF001)
    frames = FR.encode_frames(FR.events_as_frame_rows(raw))
    back = events_to_packets(FR.route_events(FR.decode_frames(frames)), index="recv_seq")
    direct = fixtures.packets(spark, SF001)
    assert back.count() == direct.count() == 1000
    assert back.exceptAll(direct).count() == 0


def test_stream_source(spark, tmp_path):
    path = str(tmp_path / "frames")
    _frames(spark).write.parquet(path)
    stream = FR.frame_source(spark, path, stream=True, max_files_per_trigger=1)
    assert stream.isStreaming
    q = (FR.decode_frames(stream).writeStream.format("memory").queryName("decoded_frames")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("decoded_frames").count() == 7


def test_kafka_adapter(spark):
    """Partitions beyond any fixed count and equal offsets of two topics stay apart; the order is by offset."""
    rows = [(b"a", "t", 0, 1), (b"b", "t", 4096, 0), (b"c", "u", 0, 1), (b"d", "t", 0, 0)]
    kafka_like = spark.createDataFrame(rows, "value binary, topic string, partition int, offset long")
    frames = FR.arrival_order(FR.kafka_frames(kafka_like)).collect()
    assert len({r["recv_seq"] for r in frames}) == 4
    assert [bytes(r["frame"]) for r in sorted(frames, key=lambda r: r["recv_seq"])] == [b"d", b"b", b"a", b"c"]


# Written byte by byte from the wire schema (tag = field number * 8 + wire type), apart from the decoder's descriptor.
EVENT = bytes.fromhex("08 95 9a ef 3a  12 02 75 31  1a 03 31 2e 31  20 bb 03  2a 03 32 2e 32  30 50"
                      "38 ff ff ff ff ff ff ff ff ff 01  42 04 63 75 72 6c  48 01  50 02  5a 02 ff 00")
HEARTBEAT = bytes.fromhex("08 05  10 07  1a 02 68 62")


def test_wire_bytes(spark):
    frames = [(0, b"\x08\x02\x12" + bytes([len(EVENT)]) + EVENT), (1, b"\x1a" + bytes([len(HEARTBEAT)]) + HEARTBEAT),
              (2, bytes.fromhex("08 01  22 03 6c 6f 67"))]
    rows = {r["recv_seq"]: r for r in FR.decode_frames(spark.createDataFrame(frames, "recv_seq bigint, frame binary")).collect()}
    e = rows[0]
    assert (e["kind"], e["timestamp"], e["uuid"], e["src_ip"], e["src_port"], e["dst_ip"], e["dst_port"]) == (
        "event", 123456789, "u1", "1.1", 443, "2.2", 80)
    assert (e["pid"], e["pname"], e["type"], e["length"], bytes(e["payload"])) == (-1, "curl", 1, 2, b"\xff\x00")
    assert (rows[1]["kind"], rows[1]["hb_timestamp"], rows[1]["hb_count"], rows[1]["hb_message"]) == ("heartbeat", 5, 7, "hb")
    assert (rows[2]["kind"], rows[2]["log_info"]) == ("process_log", "log")
