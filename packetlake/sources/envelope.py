"""The older JSON envelope ``{"log_type": n, "payload": {...}}``.

``log_type`` 0 is a heartbeat, 1 a process log, 2 *and any other value* an
event.  Event payloads accept alias keys: ``process_id``/``proc_id`` for
``pid`` and ``process_name``/``proc_name``/``comm`` for ``pname``.  Parsing is
native (``from_json``); the payload object is first kept as raw JSON text and
parsed with the schema of its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.saturate import saturate_int32

# log_type codes and field aliases of the envelope.
LOG_TYPE_HEARTBEAT, LOG_TYPE_PROCESS_LOG = 0, 1
PID_KEYS = ["pid", "process_id", "proc_id"]
PNAME_KEYS = ["pname", "process_name", "proc_name", "comm"]

CORRUPT = "_corrupt"   # filled by the parser when a field does not fit its type
ENVELOPE_DDL = f"log_type INT, payload STRING, {CORRUPT} STRING"
HEARTBEAT_DDL = f"timestamp BIGINT, count BIGINT, message STRING, {CORRUPT} STRING"
PROCESS_LOG_DDL = f"log_info STRING, {CORRUPT} STRING"
MALFORMED = "malformed envelope"
EVENT_DDL = ", ".join(
    ["index BIGINT", "timestamp BIGINT", "uuid STRING", "src_ip STRING", "src_port BIGINT", "dst_ip STRING",
     "dst_port BIGINT"]
    + [f"{k} BIGINT" for k in PID_KEYS] + [f"{k} STRING" for k in PNAME_KEYS]
    + ["type BIGINT", "length BIGINT", "is_binary BOOLEAN", "payload_utf8 STRING", "payload_binary ARRAY<INT>", f"{CORRUPT} STRING"])


def bytes_from_array(arr: Column) -> Column:
    """``[71, 69, 84]`` → binary, natively (hex text of each element, joined)."""
    return F.unhex(F.array_join(F.transform(arr, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def array_from_bytes(b: Column) -> Column:
    """Binary → array of byte values (the envelope's encoding of bytes)."""
    n = F.octet_length(b)
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    arr = F.transform(idx, lambda i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("int"))
    return F.when(n > 0, arr).otherwise(F.array().cast("array<int>"))


def parse_envelopes(df: DataFrame, text: str = "json") -> DataFrame:
    """One row per envelope: ``kind`` plus the fields of every kind (null when not it).

    A text that is no envelope is one row of kind ``error`` with its ``n_bytes``
    and ``error`` (``frames.route_bad_frames`` takes it) and never fails the job: no JSON object, no
    ``log_type``, a payload that is no object, a field of the wrong type, a pid
    beyond 32 bits, a byte outside 0–255.

    Each payload is parsed once, with the schema of its own kind, into a struct
    column of its own projection; the output fields are read from those structs
    (a parse referenced by many columns is not repeated per column).
    """
    parse = {"columnNameOfCorruptRecord": CORRUPT}
    env = df.withColumn("_env", F.from_json(F.col(text), ENVELOPE_DDL, parse))
    lt, body = F.col("_env.log_type"), F.col("_env.payload")
    whole = lt.isNotNull() & F.coalesce(F.ltrim(body).startswith("{"), F.lit(False)) & F.col("_env")[CORRUPT].isNull()
    kind = (F.when(~F.coalesce(whole, F.lit(False)), F.lit("error"))
            .when(lt == LOG_TYPE_HEARTBEAT, F.lit("heartbeat"))
            .when(lt == LOG_TYPE_PROCESS_LOG, F.lit("process_log"))
            .otherwise(F.lit("event")))
    env = env.withColumn("kind", kind)
    others = [c for c in df.columns if c != text]
    parsed = env.select(
        *others, "kind", F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.when(F.col("kind") == "heartbeat", F.from_json(body, HEARTBEAT_DDL, parse)).alias("_hb"),
        F.when(F.col("kind") == "process_log", F.from_json(body, PROCESS_LOG_DDL, parse)).alias("_pl"),
        F.when(F.col("kind") == "event", F.from_json(body, EVENT_DDL, parse)).alias("_ev"))
    pid = F.coalesce(*[F.col("_ev")[k] for k in PID_KEYS])
    bad = ((F.col("kind") == "error")
           | F.coalesce(*[F.col(c)[CORRUPT] for c in ("_hb", "_pl", "_ev")]).isNotNull()
           | F.coalesce(pid != F.expr("try_cast(coalesce(" + ", ".join(f"_ev.{k}" for k in PID_KEYS) + ") AS INT)"), pid.isNotNull())
           | F.coalesce(F.exists(F.col("_ev")["payload_binary"], lambda x: x.isNull() | (x < 0) | (x > 255)), F.lit(False)))
    parsed = parsed.withColumn("_bad", bad).select(
        *others, F.when(F.col("_bad"), F.lit("error")).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("_bad"), F.col("n_bytes")).alias("n_bytes"), F.when(F.col("_bad"), F.lit(MALFORMED)).alias("error"),
        *[F.when(~F.col("_bad"), F.col(c)).alias(c) for c in ("_hb", "_pl", "_ev")])
    ev, hb = F.col("_ev"), F.col("_hb")
    return parsed.select(
        *others, "kind", "n_bytes", "error",
        ev["index"].alias("index"),
        F.coalesce(ev["timestamp"], hb["timestamp"]).alias("timestamp"),
        *[ev[c].alias(c) for c in ["uuid", "src_ip", "src_port", "dst_ip", "dst_port"]],
        F.coalesce(*[ev[k] for k in PID_KEYS]).cast("int").alias("pid"),
        F.coalesce(*[ev[k] for k in PNAME_KEYS]).alias("pname"),
        *[ev[c].alias(c) for c in ["type", "length", "is_binary", "payload_utf8"]],
        F.when(ev.isNotNull(), bytes_from_array(ev["payload_binary"])).alias("payload_binary"),
        saturate_int32(hb["count"]).alias("count"),
        hb["message"].alias("message"),
        F.col("_pl")["log_info"].alias("log_info"),
    )


def _json_obj(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object of the non-null fields (``to_json`` drops nulls)."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields]))


def packets_as_envelopes(packets: DataFrame, log_type: Column, pid_key: Column, pname_key: Column) -> DataFrame:
    """Producer side: packets rows written as envelopes (round trips, tests).

    ``pid_key``/``pname_key`` choose the alias used for each row (0 = plain).
    """
    p = F.col
    event = _json_obj(
        [(c, p(c)) for c in ["index", "timestamp", "uuid", "src_ip", "src_port", "dst_ip", "dst_port"]]
        + [(k, F.when(pid_key == i, p("pid"))) for i, k in enumerate(PID_KEYS)]
        + [(k, F.when(pname_key == i, p("pname"))) for i, k in enumerate(PNAME_KEYS)]
        + [(c, p(c)) for c in ["type", "length", "is_binary", "payload_utf8"]]
        + [("payload_binary", array_from_bytes(p("payload_binary")))])
    heartbeat = _json_obj([("timestamp", p("timestamp")), ("count", (p("pid").cast("bigint") - 1075) * 30000000),
                           ("message", p("pname"))])
    process_log = _json_obj([("log_info", p("payload_utf8"))])
    body = (F.when(log_type == LOG_TYPE_HEARTBEAT, heartbeat)
            .when(log_type == LOG_TYPE_PROCESS_LOG, process_log).otherwise(event))
    text = F.concat(F.lit('{"log_type":'), log_type.cast("string"), F.lit(',"payload":'), body, F.lit("}"))
    return packets.select(F.col("index").alias("recv_seq"), text.alias("json"))
