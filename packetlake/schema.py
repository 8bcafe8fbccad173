"""Table schemas of the packet store and its side tables.

One append-only fact table, ``packets`` (14 columns), plus the record kinds
that arrive on the same frame stream (heartbeats, process logs) and our own
quarantine table for frames that cannot be decoded.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the ``packets`` table (fixed).
PACKET_COLS = [
    "index", "timestamp", "uuid", "src_ip", "src_port", "dst_ip", "dst_port",
    "pid", "pname", "type", "length", "is_binary", "payload_utf8", "payload_binary",
]

# The 12 columns a feed delivers: everything but the two payload columns.
TARGET_COLS = PACKET_COLS[:12]

PACKET_SCHEMA = T.StructType([
    T.StructField("index", T.LongType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("uuid", T.StringType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("src_port", T.LongType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("dst_port", T.LongType(), False),
    T.StructField("pid", T.IntegerType(), False),
    T.StructField("pname", T.StringType(), False),
    T.StructField("type", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("is_binary", T.BooleanType(), False),
    T.StructField("payload_utf8", T.StringType(), False),
    T.StructField("payload_binary", T.BinaryType(), False),
])

TARGET_SCHEMA = T.StructType(PACKET_SCHEMA.fields[:12])

# A decoded capture event before classification and numbering.  ``recv_seq``
# is the arrival order key (unique); ``pid`` is still the wire's int64.
RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("recv_seq", T.LongType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("uuid", T.StringType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("src_port", T.LongType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("dst_port", T.LongType(), False),
    T.StructField("pid", T.LongType(), False),
    T.StructField("pname", T.StringType(), False),
    T.StructField("type", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("payload", T.BinaryType(), False),
])

# Raw input: one serialized LogEntry per row, in arrival order.
FRAME_SCHEMA = T.StructType([
    T.StructField("recv_seq", T.LongType(), False),
    T.StructField("frame", T.BinaryType(), True),
])

HEARTBEAT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("count", T.IntegerType(), False),
    T.StructField("message", T.StringType(), False),
])

PROCESS_LOG_SCHEMA = T.StructType([
    T.StructField("log_info", T.StringType(), False),
])

BAD_FRAME_SCHEMA = T.StructType([
    T.StructField("recv_seq", T.LongType(), False),
    T.StructField("n_bytes", T.LongType(), False),
    T.StructField("error", T.StringType(), False),
])


def ddl(schema: T.StructType) -> str:
    """DDL string of a schema, usable as a ``readStream.schema`` argument."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
