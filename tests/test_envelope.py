"""The JSON envelope, including aliases, unknown types and bad text."""

from packetlake.sources.envelope import parse_envelopes


def test_envelopes(spark):
    rows = [
        (0, '{"log_type": 0, "payload": {"timestamp": 5, "count": 1099511627776, "message": "hb"}}'),
        (1, '{"log_type": 1, "payload": {"log_info": "started \\"x\\"\\nline 2"}}'),
        (2, '{"log_type": 2, "payload": {"index": 3, "process_id": 42, "comm": "curl", "payload_binary": [255, 216]}}'),
        (3, '{"log_type": 7, "payload": {"index": 4, "proc_id": 43, "proc_name": "wget", "payload_binary": []}}'),
        (4, 'not json'),
        (5, '{"log_type": 2}'),
    ]
    df = spark.createDataFrame(rows, "recv_seq bigint, json string")
    out = {r["recv_seq"]: r for r in parse_envelopes(df).collect()}
    assert out[0]["kind"] == "heartbeat" and out[0]["count"] == 2147483647 and out[0]["message"] == "hb"
    assert out[1]["kind"] == "process_log" and out[1]["log_info"] == 'started "x"\nline 2'
    assert out[2]["kind"] == "event" and (out[2]["pid"], out[2]["pname"]) == (42, "curl")
    assert bytes(out[2]["payload_binary"]) == b"\xff\xd8"
    assert out[3]["kind"] == "event" and (out[3]["pid"], out[3]["pname"]) == (43, "wget")
    assert bytes(out[3]["payload_binary"]) == b""
    assert out[4]["kind"] == "error" and out[5]["kind"] == "error"


def test_bad_envelopes_are_errors(spark):
    from packetlake.sources.frames import route_bad_frames

    bad = [
        '{"log_type": 2, "payload": {"pid": 1099511627776}}',               # pid beyond 32 bits
        '{"log_type": 2, "payload": {"payload_binary": [1, 256]}}',
        '{"log_type": 2, "payload": {"payload_binary": [-1]}}',
        '{"log_type": 2, "payload": {"src_port": "http"}}',                 # wrong type
        '{"payload": {"index": 1}}',                                        # no log_type
        '{"log_type": 2, "payload": 5}',
        '{"log_type": 2, "payload": [{"index": 1}]}',
        '{"log_type": "two", "payload": {"index": 1}}',
        '{"log_type": 0, "payload": {"count": "many"}}',
        '', 'null', '[]',
    ]
    rows = [(i, t) for i, t in enumerate(bad)] + [(100, '{"log_type": 2, "payload": {"pid": 2147483647}}'), (101, None)]
    parsed = parse_envelopes(spark.createDataFrame(rows, "recv_seq bigint, json string"))
    out = {r["recv_seq"]: r for r in parsed.collect()}
    assert out[100]["kind"] == "event" and out[100]["pid"] == 2147483647 and out[100]["error"] is None
    assert [i for i in out if out[i]["kind"] != "error"] == [100]
    routed = {r["recv_seq"]: r["n_bytes"] for r in route_bad_frames(parsed).collect()}
    assert routed == {i: len(t) for i, t in enumerate(bad)} | {101: None}
