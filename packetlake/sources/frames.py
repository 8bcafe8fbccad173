"""Capture frames: serialized ``LogEntry`` messages → packets, heartbeats, logs.

A frame table has ``recv_seq BIGINT, frame BINARY`` (arrival order, one
message each).  Decoding runs per partition on the executors
(``mapInArrow``, Arrow batches in and out) with the ``protobuf`` package and a
descriptor built here; the same function serves batch and streaming frames.
Routing looks only at which member of the ``payload`` oneof is set, never at
``log_type``.  A frame that cannot be decoded, or has no member, becomes a
``bad_frames`` row; the job never fails on input.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FRAME_SCHEMA, ddl
from ..session import ship_package

# The wire schema.  Only field numbers and types matter on the
# wire; the message and package names below are our own.
PROTO_PACKAGE = "packetlake.capture"
LOG_TYPES = [("LOG_TYPE_HEARTBEAT", 0), ("LOG_TYPE_PROCESS_LOG", 1), ("LOG_TYPE_EVENT", 2)]
EVENT_FIELDS = [  # name, number, protobuf type
    ("timestamp", 1, "int64"), ("uuid", 2, "string"), ("src_ip", 3, "string"), ("src_port", 4, "uint32"),
    ("dst_ip", 5, "string"), ("dst_port", 6, "uint32"), ("pid", 7, "int64"), ("pname", 8, "string"),
    ("type", 9, "uint32"), ("length", 10, "uint32"), ("payload", 11, "bytes"),
]
HEARTBEAT_FIELDS = [("timestamp", 1, "int64"), ("count", 2, "int64"), ("message", 3, "string")]
# LogEntry: log_type = 1 (LogType); oneof payload { Event event_payload = 2;
# Heartbeat heartbeat_payload = 3; string run_log = 4; }

KIND_EVENT, KIND_HEARTBEAT, KIND_LOG, KIND_ERROR = "event", "heartbeat", "process_log", "error"
MISSING_PAYLOAD = "no payload member is set"

FRAME_DDL = "recv_seq bigint, frame binary"
DECODED_DDL = (
    "recv_seq bigint, kind string, n_bytes bigint, error string, "
    "timestamp bigint, uuid string, src_ip string, src_port bigint, dst_ip string, dst_port bigint, "
    "pid bigint, pname string, type bigint, length bigint, payload binary, "
    "hb_timestamp bigint, hb_count bigint, hb_message string, log_info string"
)
_EVENT_COLS = [f[0] for f in EVENT_FIELDS]
_OUT_COLS = [c.split()[0] for c in DECODED_DDL.split(", ")]
_ARROW_TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow_schema(ddl_text: str) -> pa.Schema:
    """Arrow schema of a flat DDL string (built on executors without a session)."""
    return pa.schema([pa.field(c.split()[0], _ARROW_TYPES[c.split()[1]]) for c in ddl_text.split(", ")])


@functools.lru_cache(maxsize=1)
def message_classes():
    """(LogEntry, Event, Heartbeat) classes, built once per Python worker."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    fd = descriptor_pb2.FieldDescriptorProto
    types = {"int64": fd.TYPE_INT64, "uint32": fd.TYPE_UINT32, "string": fd.TYPE_STRING, "bytes": fd.TYPE_BYTES}
    f = descriptor_pb2.FileDescriptorProto(name="packetlake_capture.proto", package=PROTO_PACKAGE, syntax="proto3")
    enum = f.enum_type.add(name="LogType")
    for name, number in LOG_TYPES:
        enum.value.add(name=name, number=number)
    for msg_name, fields in (("Event", EVENT_FIELDS), ("Heartbeat", HEARTBEAT_FIELDS)):
        msg = f.message_type.add(name=msg_name)
        for name, number, typ in fields:
            msg.field.add(name=name, number=number, type=types[typ], label=fd.LABEL_OPTIONAL)
    entry = f.message_type.add(name="LogEntry")
    entry.oneof_decl.add(name="payload")
    entry.field.add(name="log_type", number=1, type=fd.TYPE_ENUM, label=fd.LABEL_OPTIONAL,
                    type_name=f".{PROTO_PACKAGE}.LogType")
    entry.field.add(name="event_payload", number=2, type=fd.TYPE_MESSAGE, label=fd.LABEL_OPTIONAL,
                    type_name=f".{PROTO_PACKAGE}.Event", oneof_index=0)
    entry.field.add(name="heartbeat_payload", number=3, type=fd.TYPE_MESSAGE, label=fd.LABEL_OPTIONAL,
                    type_name=f".{PROTO_PACKAGE}.Heartbeat", oneof_index=0)
    entry.field.add(name="run_log", number=4, type=fd.TYPE_STRING, label=fd.LABEL_OPTIONAL, oneof_index=0)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    get = lambda n: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{PROTO_PACKAGE}.{n}"))
    return get("LogEntry"), get("Event"), get("Heartbeat")


def _decode_batches(batches):
    schema = _arrow_schema(DECODED_DDL)
    log_entry = message_classes()[0]
    for rb in batches:
        cols = {c: [] for c in _OUT_COLS}
        put = {c: cols[c].append for c in _OUT_COLS}
        for seq, frame in zip(rb.column("recv_seq").to_pylist(), rb.column("frame").to_pylist()):
            if frame is None:
                continue  # not a binary message: ignored
            member, error, entry = None, None, None
            try:
                entry = log_entry.FromString(frame)
                member = entry.WhichOneof("payload")
                if member is None:
                    error = MISSING_PAYLOAD
            except Exception as exc:  # noqa: BLE001 – any decode failure is quarantined
                error = f"decode error: {exc}"
            put["recv_seq"](seq)
            put["n_bytes"](len(frame))
            put["error"](error)
            if member == "event_payload":
                ev = entry.event_payload
                put["kind"](KIND_EVENT)
                for name in _EVENT_COLS:
                    put[name](getattr(ev, name))
            else:
                for name in _EVENT_COLS:
                    put[name](None)
            if member == "heartbeat_payload":
                hb = entry.heartbeat_payload
                put["kind"](KIND_HEARTBEAT)
                put["hb_timestamp"](hb.timestamp)
                put["hb_count"](hb.count)
                put["hb_message"](hb.message)
            else:
                put["hb_timestamp"](None)
                put["hb_count"](None)
                put["hb_message"](None)
            if member == "run_log":
                put["kind"](KIND_LOG)
                put["log_info"](entry.run_log)
            else:
                put["log_info"](None)
            if error is not None:
                put["kind"](KIND_ERROR)
        yield pa.RecordBatch.from_pydict(cols, schema=schema)


def frame_source(spark: SparkSession, path: str, stream: bool = False,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Frames stored as Parquet (``recv_seq``, ``frame``), batch or stream."""
    if not stream:
        return spark.read.schema(FRAME_SCHEMA).parquet(path)
    reader = spark.readStream.schema(ddl(FRAME_SCHEMA))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(path)


def kafka_frames(kafka_df: DataFrame) -> DataFrame:
    """Frames from a Kafka source: ``value`` is the frame, told apart by topic, partition and offset.

    Each micro-batch is given its arrival order by :func:`arrival_order`.
    """
    return kafka_df.select("topic", "partition", "offset", F.col("value").alias("frame"))


def arrival_order(batch: DataFrame) -> DataFrame:
    """(recv_seq, frame) of a batch of Kafka frames, by offset, then topic and partition.

    recv_seq is the offset times the number of the batch's partitions, plus the
    partition's rank among them: unique within the batch, and the same when the
    batch is replayed.  The driver sees one row per Kafka partition.
    """
    parts = [tuple(r) for r in batch.select("topic", "partition").distinct().collect()]
    ranked = [(t, p, i) for i, (t, p) in enumerate(sorted(parts))]
    ranks = batch.sparkSession.createDataFrame(ranked, "topic string, partition int, _rank bigint")
    return batch.join(F.broadcast(ranks), ["topic", "partition"]).select(
        (F.col("offset").cast("bigint") * len(ranked) + F.col("_rank")).alias("recv_seq"), "frame")


def decode_frames(frames: DataFrame) -> DataFrame:
    """One decoded row per frame (schema ``DECODED_DDL``), on the input's own splits."""
    ship_package(frames.sparkSession)
    return frames.select("recv_seq", "frame").mapInArrow(_decode_batches, DECODED_DDL)


# S3: routes
def route_events(decoded: DataFrame) -> DataFrame:
    """Events, ready for ``events_to_packets`` (after numbering)."""
    return decoded.filter(F.col("kind") == KIND_EVENT).select("recv_seq", *_EVENT_COLS)


def route_heartbeats(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("kind") == KIND_HEARTBEAT).select(
        "recv_seq", F.col("hb_timestamp").alias("timestamp"), F.col("hb_count").alias("count"),
        F.col("hb_message").alias("message"))


def route_process_logs(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("kind") == KIND_LOG).select("recv_seq", "log_info")


# S4
def route_bad_frames(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("kind") == KIND_ERROR).select("recv_seq", "n_bytes", "error")


# Producer side, used to turn table rows into frames (tests and round trips).
def _encode_batches(batches):
    log_entry, event, heartbeat = message_classes()
    schema = _arrow_schema(FRAME_DDL)
    for rb in batches:
        data = rb.to_pydict()
        out_seq, out_frame = [], []
        for i, seq in enumerate(data["recv_seq"]):
            member = data["member"][i]
            fields = {"log_type": int(data["log_type"][i] or 0)}
            if member == KIND_EVENT:
                fields["event_payload"] = event(**{k: data[k][i] for k in _EVENT_COLS if data[k][i] is not None})
            elif member == KIND_HEARTBEAT:
                fields["heartbeat_payload"] = heartbeat(timestamp=data["timestamp"][i] or 0,
                                                        count=data["count"][i] or 0,
                                                        message=data["message"][i] or "")
            elif member == KIND_LOG:
                fields["run_log"] = data["log_info"][i] or ""
            out_seq.append(seq)
            out_frame.append(log_entry(**fields).SerializeToString())
        yield pa.RecordBatch.from_pydict({"recv_seq": out_seq, "frame": out_frame}, schema=schema)


ENCODE_INPUT_COLS = ["recv_seq", "member", "log_type", *_EVENT_COLS, "count", "message", "log_info"]


def encode_frames(rows: DataFrame) -> DataFrame:
    """Serialize rows into frames.  ``rows`` has ``ENCODE_INPUT_COLS``; ``member``
    picks the oneof member (``event``/``heartbeat``/``process_log``, else none)."""
    ship_package(rows.sparkSession)
    return rows.select(*ENCODE_INPUT_COLS).mapInArrow(_encode_batches, FRAME_DDL)


def events_as_frame_rows(raw: DataFrame, log_type: int = 2) -> DataFrame:
    """Raw events (``RAW_EVENT_SCHEMA``) as encoder input rows."""
    return raw.select(
        "recv_seq", F.lit(KIND_EVENT).alias("member"), F.lit(log_type).alias("log_type"), *_EVENT_COLS,
        F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("string").alias("log_info"))
