"""Registered queries: one per operator of the inventory, each with its oracle.

Every query reads the driver's tables (``events``, ``documents``) through the
fixture source and runs over the whole derived ``packets`` table.  Binary
columns leave as upper-case hex so that both engines compare equal text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render as R
from ..functions.saturate import saturate_int32
from ..operators import listing as L
from ..operators import query as Q
from ..operators.normalise import events_to_packets, normalise_heartbeats
from ..operators.numbering import assign_index, number_by_key
from ..schema import TARGET_COLS
from ..session import prepare
from ..sources import fixtures
from . import oracle as O

CURSOR = 100  # the feed cursor used by the registered feeds


@dataclass(frozen=True)
class Spec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Spec] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = Spec(name, fn, oracle)
        return fn
    return deco


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ``packets`` table of the fixture (written on first use)."""
    return fixtures.packets_table(prepare(spark), sf_dir)


def derived_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packets`` computed from the raw tables (the ingest path itself)."""
    return fixtures.packets(prepare(spark), sf_dir)


def source(sf_dir: str):
    return lambda session: fixtures.packets_table(prepare(session), sf_dir)


def hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("payload_binary", F.hex("payload_binary"))


# ---------------------------------------------------------------- Mode A feeds
# The documented example filters.
CONDITIONS = {
    # P5 (the minimum slice, also ``entry``)
    "condition_filter": "is_binary = false AND payload_utf8 LIKE '%password%'",
    # P10 … P16 and L1: the documented filter corpus
    "pred_eq_in": "dst_port IN (80, 443)",
    "pred_neq_and": "src_ip != '127.0.0.1' AND dst_ip != '127.0.0.1' AND src_ip != '::1'",
    "pred_neq_and_noise": "dst_port != 53 AND pname != 'mDNSResponder'",
    "pred_like_prefix": "src_ip LIKE '192.168.1.%'",
    "pred_like_prefix_get": "is_binary = false AND payload_utf8 LIKE 'GET %'",
    "pred_like_contains": "is_binary = false AND (payload_utf8 LIKE '%password%' OR payload_utf8 LIKE '%token%')",
    "pred_like_contains_host": "is_binary = false AND payload_utf8 LIKE '%example.com%'",
    "pred_like_enclosed": "is_binary = false AND payload_utf8 LIKE '{%}'",
    "pred_or_group": "(src_ip = '192.168.1.5' OR dst_port = 3306) AND length < 1000",
    "pred_lower_eq": "lower(pname) = 'curl'",
    "order_by_index": "pname = 'python' OR pname LIKE 'chrome%'",
}


def _mode_a(cond: str):
    return lambda spark, sf: Q.condition_filter(packets(spark, sf), cond, CURSOR)


for _name, _cond in CONDITIONS.items():
    register(_name, O.feed(_cond, CURSOR))(_mode_a(_cond))

# Blank condition → every row after the cursor
register("empty_condition", O.feed("1=1", CURSOR))(
    lambda spark, sf: Q.condition_filter(packets(spark, sf), "   ", CURSOR))

# ---------------------------------------------------------------- Mode B feeds
# Full statements after the documented examples.
FULL_SQL = {
    "full_select": "SELECT * FROM packets WHERE length > 100 AND is_binary = false ;",
    "mode_dispatch": "  with big AS (SELECT * FROM packets WHERE length >= 1000) "
                     "SELECT * FROM big WHERE pname <> 'curl'  ",
    "union_distinct": "SELECT * FROM packets WHERE pname = 'curl'\nUNION\nSELECT * FROM packets WHERE pname = 'wget'",
    "derived_table": "SELECT * FROM (SELECT * FROM packets WHERE dst_port = 443) AS t WHERE pname = 'wget'",
}


def _mode_b(sql: str):
    return lambda spark, sf: Q.customized(source(sf), sql, CURSOR, base=prepare(spark))


for _name, _sql in FULL_SQL.items():
    register(_name, O.full(Q.clean_full_sql(_sql), CURSOR))(_mode_b(_sql))

# U1 with one scan: the OR of the branch conditions (``index`` is unique).
register("union_by_index", O.full(Q.clean_full_sql(FULL_SQL["union_distinct"]), CURSOR))(
    lambda spark, sf: Q.union_by_index(packets(spark, sf), ["pname = 'curl'", "pname = 'wget'"], CURSOR))

# ---------------------------------------------------------------- plain reads
register("all_packets", O.over_packets(f"SELECT {O.ALL_HEX} FROM packets"))(
    lambda spark, sf: hexed(Q.all_packets(packets(spark, sf))))
register("project_no_payload", O.over_packets(f"SELECT {O.TARGET} FROM packets"))(
    lambda spark, sf: Q.project_no_payload(packets(spark, sf)))
register("since_index", O.over_packets(f"SELECT {O.ALL_HEX} FROM packets WHERE index > {CURSOR} ORDER BY index"))(
    lambda spark, sf: hexed(Q.since_index(packets(spark, sf), CURSOR)))
register("since_index_no_payload",
         O.over_packets(f"SELECT {O.TARGET} FROM packets WHERE index > {CURSOR} ORDER BY index"))(
    lambda spark, sf: Q.since_index_no_payload(packets(spark, sf), CURSOR))
register("packet_by_index", O.over_packets(f"SELECT {O.ALL_HEX} FROM packets WHERE index = 987 LIMIT 1"))(
    lambda spark, sf: hexed(Q.packet_by_index(packets(spark, sf), 987)))
register("limit_one", O.over_packets(f"SELECT {O.ALL_HEX} FROM packets WHERE index = 500 LIMIT 1"))(
    lambda spark, sf: hexed(Q.packet_by_index(packets(spark, sf), 500)))
register("offset", O.over_packets(f"SELECT {O.ALL_HEX} FROM packets ORDER BY index OFFSET {CURSOR}"))(
    lambda spark, sf: hexed(Q.offset(packets(spark, sf), CURSOR)))
register("delivered_count", O.over_packets(
    f"SELECT count(*) AS delivered FROM packets WHERE (dst_port IN (80, 443)) AND index > {CURSOR}"))(
    lambda spark, sf: Q.delivered_count(Q.customized(packets(spark, sf), "dst_port IN (80, 443)", CURSOR)))

# ---------------------------------------------------------------- payload
register("payload_classify", O.over_packets("SELECT index, length, is_binary FROM packets"))(
    lambda spark, sf: derived_packets(spark, sf).select("index", "length", "is_binary"))
register("payload_split", O.over_packets(
    "SELECT index, is_binary, payload_utf8, hex(payload_binary) AS payload_binary FROM packets"))(
    lambda spark, sf: hexed(derived_packets(spark, sf).select("index", "is_binary", "payload_utf8", "payload_binary")))

# ---------------------------------------------------------------- normalisation
WIDE_PID_SQL = "(pid - 1075) * 30000000"   # raw wire pid spread over ±2.25e9


def _wide_pid_raw(spark, sf) -> DataFrame:
    raw = fixtures.raw_events(prepare(spark), sf)
    return raw.withColumn("pid", (F.col("pid") - 1075) * 30000000)


register("event_to_packet", O.over_packets(
    f"SELECT {O.ALL_HEX.replace('pid,', 'cast(least(greatest((cast(pid AS bigint) - 1075) * 30000000, -2147483648), 2147483647) AS int) AS pid,', 1)} FROM packets"))(
    lambda spark, sf: hexed(events_to_packets(_wide_pid_raw(spark, sf), index="recv_seq")))
register("pid_saturate", O.over_packets(
    "SELECT index, (cast(pid AS bigint) - 1075) * 30000000 AS raw_pid, "
    "cast(least(greatest((cast(pid AS bigint) - 1075) * 30000000, -2147483648), 2147483647) AS int) AS pid FROM packets"))(
    lambda spark, sf: _wide_pid_raw(spark, sf).select(
        F.col("recv_seq").alias("index"), F.col("pid").alias("raw_pid"), saturate_int32("pid").alias("pid")))

_HB_ORACLE = ("SELECT event_id, epoch_us(ts) * 1000 AS timestamp, "
              "cast(least(greatest((user_id - 75) * 30000000, -2147483648), 2147483647) AS int) AS count, "
              "event_type AS message FROM events")


def _heartbeats(spark, sf) -> DataFrame:
    ev = fixtures.table(prepare(spark), sf, "events")
    hb = ev.select("event_id",
                   (fixtures.epoch_micros(F.col("ts"), ev.schema["ts"].dataType) * 1000).alias("timestamp"),
                   ((F.col("user_id") - 75) * 30000000).alias("count"),
                   F.col("event_type").alias("message"))
    return normalise_heartbeats(hb)


register("heartbeat_normalise", _HB_ORACLE)(_heartbeats)

# ---------------------------------------------------------------- numbering
register("assign_index", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS index FROM events")(
    lambda spark, sf: assign_index(fixtures.table(prepare(spark), sf, "events").select("event_id", "ts"),
                                   order_col=["ts", "event_id"]).select("event_id", "index"))

# By one integral key, here in another order than the files', over ranges small enough that every table has several.
register("number_by_key", "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id % 1000, event_id) - 1 AS index FROM events")(
    lambda spark, sf: number_by_key(
        fixtures.table(prepare(spark), sf, "events").select(
            "event_id", "user_id", (F.col("event_id") % 1000 * 10 ** 12 + F.col("event_id")).alias("key")),
        "key", rows_per_range=256).select("event_id", "user_id", "index"))

# ---------------------------------------------------------------- rendering (F1 … F13)
# Raw timestamps in every unit the rules tell apart, derived from the packets.
RAW_TS_SQL = ("CASE index % 6 WHEN 0 THEN timestamp WHEN 1 THEN timestamp // 1000 "
              "WHEN 2 THEN timestamp // 1000000 WHEN 3 THEN timestamp // 1000000000 "
              "WHEN 4 THEN index ELSE 0 - index END")


def _raw_ts(df: DataFrame) -> DataFrame:
    i, t = F.col("index"), F.col("timestamp")
    div = lambda c, d: F.call_function("div", c, F.lit(d))
    raw = (F.when(i % 6 == 0, t).when(i % 6 == 1, div(t, 1000)).when(i % 6 == 2, div(t, 10**6))
           .when(i % 6 == 3, div(t, 10**9)).when(i % 6 == 4, i).otherwise(-i))
    return df.withColumn("raw_ts", raw)


def _over_raw_ts(select: str) -> str:
    return O.over_packets(f"SELECT {select} FROM (SELECT index, {RAW_TS_SQL} AS raw_ts FROM packets) r")


register("epoch_millis", _over_raw_ts(f"index, raw_ts, {O.millis('raw_ts')} AS millis"))(
    lambda spark, sf: _raw_ts(packets(spark, sf)).select("index", "raw_ts", R.epoch_millis("raw_ts").alias("millis")))
register("to_timestamp", _over_raw_ts(f"index, raw_ts, epoch_ms({O.millis('raw_ts')}) AS ts_utc"))(
    lambda spark, sf: _raw_ts(packets(spark, sf)).select("index", "raw_ts", R.to_timestamp("raw_ts").alias("ts_utc")))
register("format_time", _over_raw_ts(
    f"index, raw_ts, {O.fmt_time('raw_ts', False)} AS time, {O.fmt_time('raw_ts', True)} AS time_with_date"))(
    lambda spark, sf: _raw_ts(packets(spark, sf)).select(
        "index", "raw_ts", R.format_time("raw_ts").alias("time"),
        R.format_time("raw_ts", include_date=True).alias("time_with_date")))
register("format_time_ns", _over_raw_ts(
    f"index, raw_ts, {O.fmt_time_ns('raw_ts', False)} AS time_ns, {O.fmt_time_ns('raw_ts', True)} AS time_ns_with_date"))(
    lambda spark, sf: _raw_ts(packets(spark, sf)).select(
        "index", "raw_ts", R.format_time_ns("raw_ts").alias("time_ns"),
        R.format_time_ns("raw_ts", include_date=True).alias("time_ns_with_date")))

SIZE_SQL = ("CASE index % 5 WHEN 0 THEN length WHEN 1 THEN length * 37 WHEN 2 THEN length * 5000 "
            "WHEN 3 THEN 0 - length ELSE length * 1024 END")


def _sized(df: DataFrame) -> DataFrame:
    i, n = F.col("index"), F.col("length")
    return df.withColumn("bytes", F.when(i % 5 == 0, n).when(i % 5 == 1, n * 37).when(i % 5 == 2, n * 5000)
                         .when(i % 5 == 3, -n).otherwise(n * 1024))


register("format_size", O.over_packets(
    f"SELECT index, bytes, {O.fmt_size('bytes')} AS size FROM (SELECT index, {SIZE_SQL} AS bytes FROM packets) s"))(
    lambda spark, sf: _sized(packets(spark, sf)).select("index", "bytes", R.format_size("bytes").alias("size")))
register("protocol_name", O.over_packets(f"SELECT index, type, {O.protocol('type')} AS protocol FROM packets"))(
    lambda spark, sf: packets(spark, sf).select("index", "type", R.protocol_name("type").alias("protocol")))

# Labels over rows where some fields are missing (empty ip/name, null port/pid).
GAPS_SQL = ("SELECT index, CASE WHEN index % 9 = 0 THEN '' ELSE src_ip END AS src_ip, "
            "CASE WHEN index % 10 = 0 THEN NULL ELSE src_port END AS src_port, dst_ip, dst_port, "
            "CASE WHEN index % 8 = 0 THEN '' ELSE pname END AS pname, "
            "CASE WHEN index % 12 = 0 THEN NULL ELSE pid END AS pid FROM packets")


def _gaps(df: DataFrame) -> DataFrame:
    i = F.col("index")
    return df.select(
        "index", F.when(i % 9 == 0, F.lit("")).otherwise(F.col("src_ip")).alias("src_ip"),
        F.when(i % 10 == 0, F.lit(None)).otherwise(F.col("src_port")).alias("src_port"), "dst_ip", "dst_port",
        F.when(i % 8 == 0, F.lit("")).otherwise(F.col("pname")).alias("pname"),
        F.when(i % 12 == 0, F.lit(None)).otherwise(F.col("pid")).alias("pid"))


register("endpoint_label", O.over_packets(
    f"SELECT index, {O.endpoint('src_ip', 'src_port')} AS source, {O.endpoint('dst_ip', 'dst_port')} AS destination "
    f"FROM ({GAPS_SQL}) g"))(
    lambda spark, sf: _gaps(packets(spark, sf)).select(
        "index", R.endpoint_label("src_ip", "src_port").alias("source"),
        R.endpoint_label("dst_ip", "dst_port").alias("destination")))
register("process_label", O.over_packets(
    f"SELECT index, {O.process('pname', 'pid')} AS process FROM ({GAPS_SQL}) g"))(
    lambda spark, sf: _gaps(packets(spark, sf)).select("index", R.process_label("pname", "pid").alias("process")))
register("hex_dump", O.over_packets(f"SELECT index, {O.hexdump('payload_binary')} AS dump FROM packets"))(
    lambda spark, sf: packets(spark, sf).select("index", R.hex_dump("payload_binary").alias("dump")))
register("payload_render", O.over_packets(
    f"SELECT index, {O.render_payload('is_binary', 'payload_utf8', 'payload_binary')} AS payload FROM packets"))(
    lambda spark, sf: packets(spark, sf).select(
        "index", R.payload_render("is_binary", "payload_utf8", "payload_binary").alias("payload")))

ISSUES_SQL = ("SELECT index, CASE WHEN index % 7 = 0 THEN NULL ELSE timestamp END AS timestamp, "
              "CASE WHEN index % 11 = 0 THEN NULL ELSE uuid END AS uuid, "
              "CASE WHEN index % 13 = 0 THEN NULL ELSE type END AS type, length, "
              "CASE WHEN index % 17 = 0 THEN NULL ELSE is_binary END AS is_binary FROM packets")


def _holes(df: DataFrame) -> DataFrame:
    i = F.col("index")
    return df.select(
        "index", F.when(i % 7 == 0, F.lit(None)).otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(i % 11 == 0, F.lit(None)).otherwise(F.col("uuid")).alias("uuid"),
        F.when(i % 13 == 0, F.lit(None)).otherwise(F.col("type")).alias("type"), "length",
        F.when(i % 17 == 0, F.lit(None)).otherwise(F.col("is_binary")).alias("is_binary"))


_ISSUE_LIST = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c} is missing' END" for c in R.ISSUE_COLS)
register("packet_issues", O.over_packets(
    f"SELECT index, array_to_string(list_filter([{_ISSUE_LIST}], lambda x: x IS NOT NULL), '; ') AS issues, "
    f"len(list_filter([{_ISSUE_LIST}], lambda x: x IS NOT NULL)) = 0 AS valid FROM ({ISSUES_SQL}) h"))(
    lambda spark, sf: _holes(packets(spark, sf)).select(
        "index", F.array_join(R.packet_issues(), "; ").alias("issues"), R.packet_valid().alias("valid")))

register("packet_listing", O.over_packets(
    f"SELECT index, {O.fmt_time('timestamp', False)} AS time, {O.process('pname', 'pid')} AS process, "
    f"{O.endpoint('src_ip', 'src_port')} AS source, {O.endpoint('dst_ip', 'dst_port')} AS destination, "
    f"{O.protocol('type')} AS protocol, {O.fmt_size('length')} AS size FROM packets"))(
    lambda spark, sf: L.packet_listing(packets(spark, sf)))

DETAIL_IDS = "dst_port = 3306"
register("packet_detail", O.over_packets(
    f"SELECT index, {O.fmt_time('timestamp', True)} AS time, coalesce(nullif(uuid, ''), 'N/A') AS uuid, "
    f"{O.protocol('type')} AS protocol, {O.fmt_size('length')} AS size, "
    f"{O.endpoint('src_ip', 'src_port')} AS source, {O.endpoint('dst_ip', 'dst_port')} AS destination, "
    f"coalesce(nullif(pname, ''), 'N/A') AS process_name, coalesce(cast(pid AS varchar), 'N/A') AS pid, "
    f"{O.render_payload('is_binary', 'payload_utf8', 'payload_binary')} AS payload, true AS valid "
    f"FROM packets WHERE index IN (SELECT index FROM packets WHERE ({DETAIL_IDS}) AND index > {CURSOR})"))(
    lambda spark, sf: L.packet_detail(Q.lookup_many(
        packets(spark, sf), Q.condition_filter(packets(spark, sf), DETAIL_IDS, CURSOR))))


# P13, P14 through the trigram index, P9 for scattered ids through the zone map.
def _searched(patterns: list[str]):
    return lambda spark, sf: Q.since_index_no_payload(
        fixtures.packets_index(prepare(spark), sf).search(patterns, ~F.col("is_binary")), CURSOR)


register("payload_search", O.feed(CONDITIONS["pred_like_contains"], CURSOR))(_searched(["%password%", "%token%"]))
register("payload_search_enclosed", O.feed(CONDITIONS["pred_like_enclosed"], CURSOR))(_searched(["{%}"]))
register("lookup_scattered", O.over_packets(
    f"SELECT {O.ALL_HEX} FROM packets WHERE index IN (SELECT event_id * 7 FROM events WHERE event_id % 50 = 0)"))(
    lambda spark, sf: hexed(fixtures.packets_index(prepare(spark), sf).lookup(
        fixtures.table(spark, sf, "events").where("event_id % 50 = 0").select((F.col("event_id") * 7).alias("index")))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spec.build for name, spec in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: spec.oracle for name, spec in REGISTRY.items() if spec.oracle is not None}


__all__ = ["REGISTRY", "queries", "oracle_sql", "TARGET_COLS", "CURSOR"]


# ---------------------------------------------------------------- frames (S1–S4) and envelope
def _frames_of_events(spark, sf) -> DataFrame:
    from ..sources import frames as FR
    raw = fixtures.raw_events(prepare(spark), sf)
    return FR.encode_frames(FR.events_as_frame_rows(raw))


def _decode_round_trip(spark, sf) -> DataFrame:
    from ..sources import frames as FR
    decoded = FR.decode_frames(_frames_of_events(spark, sf))
    return hexed(events_to_packets(FR.route_events(decoded), index="recv_seq"))


register("decode_frames", O.over_packets(f"SELECT {O.ALL_HEX} FROM packets"))(_decode_round_trip)

_SAT_HB = "cast(least(greatest((cast(pid AS bigint) - 1075) * 30000000, -2147483648), 2147483647) AS int)"


def _mixed_decoded(spark, sf) -> DataFrame:
    """Frames of every kind from the raw events (by ``recv_seq % 4``), decoded."""
    from ..sources import frames as FR
    raw = fixtures.raw_events(prepare(spark), sf)
    k = F.col("recv_seq") % 4
    rows = FR.events_as_frame_rows(raw).select(
        "recv_seq",
        F.when(k == 0, F.lit(FR.KIND_HEARTBEAT)).when(k == 1, F.lit(FR.KIND_LOG))
         .when(k == 2, F.lit(FR.KIND_EVENT)).otherwise(F.lit("none")).alias("member"),
        *[c for c in FR.ENCODE_INPUT_COLS if c not in ("recv_seq", "member", "count", "message", "log_info")],
        ((F.col("pid") - 1075) * 30000000).alias("count"), F.col("pname").alias("message"),
        F.col("uuid").alias("log_info"))
    return FR.decode_frames(FR.encode_frames(rows))


def _mixed_frames(spark, sf) -> DataFrame:
    from ..sources import frames as FR
    decoded = _mixed_decoded(spark, sf)
    kind = F.col("kind")
    return decoded.select(
        "recv_seq", "kind", F.when(kind == FR.KIND_EVENT, F.col("pname")).alias("pname"),
        F.when(kind == FR.KIND_HEARTBEAT, saturate_int32("hb_count")).alias("count"),
        F.col("hb_message").alias("message"), "log_info", "error")


register("route_frames", O.over_packets(
    "SELECT index AS recv_seq, CASE index % 4 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'process_log' "
    "WHEN 2 THEN 'event' ELSE 'error' END AS kind, CASE WHEN index % 4 = 2 THEN pname END AS pname, "
    f"CASE WHEN index % 4 = 0 THEN {_SAT_HB} END AS count, CASE WHEN index % 4 = 0 THEN pname END AS message, "
    "CASE WHEN index % 4 = 1 THEN uuid END AS log_info, "
    "CASE WHEN index % 4 = 3 THEN 'no payload member is set' END AS error FROM packets"))(_mixed_frames)

def _route_bad(spark, sf) -> DataFrame:
    from ..sources import frames as FR
    return FR.route_bad_frames(_mixed_decoded(spark, sf))


# The quarantine route of the same stream (a frame with no member is 2 bytes: log_type = 2).
register("bad_frames", O.over_packets(
    "SELECT index AS recv_seq, cast(2 AS bigint) AS n_bytes, 'no payload member is set' AS error "
    "FROM packets WHERE index % 4 = 3"))(_route_bad)


def _envelopes(spark, sf) -> DataFrame:
    from ..sources import envelope as EN
    p = packets(spark, sf)
    i = F.col("index")
    env = EN.packets_as_envelopes(p, log_type=i % 5, pid_key=i % 3, pname_key=F.call_function("div", i, F.lit(5)) % 4)
    parsed = EN.parse_envelopes(env)
    return parsed.select("recv_seq", "kind", F.col("index").alias("packet_index"), "pid", "pname", "payload_utf8",
                         F.hex("payload_binary").alias("payload_binary"), "count", "message", "log_info")


register("json_envelope", O.over_packets(
    "SELECT index AS recv_seq, CASE index % 5 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'process_log' ELSE 'event' END AS kind, "
    "CASE WHEN index % 5 >= 2 THEN index END AS packet_index, CASE WHEN index % 5 >= 2 THEN pid END AS pid, "
    "CASE WHEN index % 5 >= 2 THEN pname END AS pname, CASE WHEN index % 5 >= 2 THEN payload_utf8 END AS payload_utf8, "
    "CASE WHEN index % 5 >= 2 THEN hex(payload_binary) END AS payload_binary, "
    f"CASE WHEN index % 5 = 0 THEN {_SAT_HB} END AS count, CASE WHEN index % 5 = 0 THEN pname END AS message, "
    "CASE WHEN index % 5 = 1 THEN payload_utf8 END AS log_info FROM packets"))(_envelopes)


from . import streams  # noqa: E402,F401 – registers the queries of the streaming operators
