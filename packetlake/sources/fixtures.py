"""Capture traffic derived from the driver's tables (``events`` + ``documents``).

There is no capture archive in the test data, so the raw events are derived
from ``events`` with the mapping below; ``documents`` provides long, multi-
byte text payloads.  The raw events then go through the same classification
as decoded frames do.  ``recv_seq`` (arrival order) is ``event_id``.
"""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import bounded_broadcast_join, fits, measure
from ..operators.normalise import events_to_packets
from ..operators.partitioning import spread
from ..operators.skipping import FileIndex
from ..schema import PACKET_SCHEMA
from ..session import checkpoint_dir, shuffles_freed
from . import storage

# Fixed values of the derivation (must equal the oracle SQL).
DST_HOSTS = 200                      # dst_ip ends in event_id % 200
KINDS = 6                            # event e of kind 4 uses document (e div 6) % number of documents
HTTP_HOST = "shop.example.com"
PNAMES = ["curl", "wget", "chrome", "python3", "mDNSResponder"]   # by event_id % 5
DST_PORTS = [80, 443, 8080, 53, 3306, 443, 443]                   # by event_id % 7
LOOPBACK = "127.0.0.1"                                            # dst_ip when event_id % 11 = 0
LONG_TEXT = 256                      # bytes of a payload that is kept beside its equals
DOCUMENT_PARTS = 4                   # parts, by document, that a table is written in where the documents are shuffled
THIRD_STATE_EVERY = 97                                            # kind 6 when event_id % 97 = 0
# kind 0 GET request, 1 props JSON, 2 login form, 3 binary (ffd8 + md5),
# 4 document text, 5 empty, 6 120 × 'a' then 0xff (text prefix, invalid whole)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def epoch_micros(ts: Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch; zone-free for TIMESTAMP_NTZ columns."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)
    return F.unix_micros(ts.cast("timestamp"))


def _kind(eid: Column) -> Column:
    return F.when(eid % THIRD_STATE_EVERY == 0, F.lit(6)).otherwise(eid % 6)


def _case(key: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def document_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(rows, bytes of text) of the documents."""
    return measure(table(spark, sf_dir, "documents").select("text"), F.octet_length("text"))


def raw_events(spark: SparkSession, sf_dir: str, by_range: bool = False, measured: tuple[int, int] | None = None,
               part: int | None = None) -> DataFrame:
    """Decoded events with byte payloads (FIXTURES §2), schema ``RAW_EVENT_SCHEMA``.

    ``by_range`` range-partitions the events by ``event_id`` (= ``recv_seq``)
    before anything is derived: the range sampler then reads only the scan,
    and every later step is narrow, so the ranges reach the output as they are.
    Documents too big to broadcast are joined by a shuffle on their id instead: only the
    events that look one up are shuffled, by their key columns; the others stay in their splits.
    ``part`` of such a join: the events of every ``DOCUMENT_PARTS``-th document, and in part 0 those that look none up.
    """
    ev = table(spark, sf_dir, "events")
    ts_type = ev.schema["ts"].dataType
    ev = ev.select("event_id", "ts", "user_id", "props")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs, doc_bytes = measured or document_size(spark, sf_dir)
    eid, uid = F.col("event_id"), F.col("user_id")
    uses_doc = _kind(eid).eqNullSafe(4)
    doc = F.when(uses_doc, F.call_function("div", eid, F.lit(KINDS)) % max(n_docs, 1)).alias("_doc")

    def with_text(rows: DataFrame) -> DataFrame:
        return bounded_broadcast_join(rows, docs, "_doc", "doc_id", width=F.octet_length("text"), salt=F.xxhash64("event_id"),
                                      how="left", measured=(n_docs, doc_bytes))

    if fits(n_docs, doc_bytes):
        ev = ev.repartitionByRange("event_id") if by_range else spread(ev, "event_id")
        # Only kind 4 looks a document up; the others pass the left join with a null key.
        joined = with_text(ev.select("*", doc))
    else:
        looking_up = ev.where(uses_doc).select("event_id", "ts", "user_id", doc)
        if part is not None:
            looking_up, docs = (rows.where(F.pmod(key, F.lit(DOCUMENT_PARTS)) == part) for rows, key in ((looking_up, "_doc"), (docs, "doc_id")))
        joined = with_text(looking_up).withColumn("props", F.lit(None).cast(ev.schema["props"].dataType))
        if not part:
            joined = joined.unionByName(spread(ev.where(~uses_doc), "event_id"), allowMissingColumns=True)
    kind = _kind(eid)
    text = (F.when(kind == 0, F.concat(F.lit("GET /item/"), uid.cast("string"), F.lit(" HTTP/1.1\nHost: " + HTTP_HOST)))
            .when(kind == 1, F.col("props"))
            .when(kind == 2, F.concat(F.lit("POST /login password=p"), eid.cast("string")))
            .when(kind == 4, F.coalesce("text", F.lit(""))))
    payload = (F.when(kind == 3, F.unhex(F.concat(F.lit("ffd8"), F.md5(eid.cast("string")))))
               .when(kind == 5, F.lit(bytearray()))
               .when(kind == 6, F.unhex(F.lit("61" * 120 + "ff")))
               .otherwise(text.cast("binary")))
    return (joined.select(
        eid.alias("recv_seq"),
        (epoch_micros(F.col("ts"), ts_type) * 1000).alias("timestamp"),
        F.md5(eid.cast("string")).alias("uuid"),
        F.concat(F.lit("192.168."), (uid % 4).cast("string"), F.lit("."), (uid % 250).cast("string")).alias("src_ip"),
        (F.lit(32768) + eid % 28000).cast("bigint").alias("src_port"),
        F.when(eid % 11 == 0, F.lit(LOOPBACK)).otherwise(
            F.concat(F.lit("104.16."), (eid % 3).cast("string"), F.lit("."), (eid % DST_HOSTS).cast("string"))).alias("dst_ip"),
        _case(eid % 7, DST_PORTS).cast("bigint").alias("dst_port"),
        (F.lit(1000) + uid).cast("bigint").alias("pid"),
        _case(eid % 5, PNAMES).alias("pname"),
        (eid % 7).cast("bigint").alias("type"),
        payload.alias("payload"))
        .withColumn("length", F.octet_length("payload").cast("bigint"))
        .select("recv_seq", "timestamp", "uuid", "src_ip", "src_port", "dst_ip", "dst_port",
                "pid", "pname", "type", "length", "payload"))


def packets(spark: SparkSession, sf_dir: str, by_range: bool = False, measured: tuple[int, int] | None = None,
            part: int | None = None) -> DataFrame:
    """The ``packets`` table of the fixture; ``index`` = ``recv_seq`` (gap-free here)."""
    return events_to_packets(raw_events(spark, sf_dir, by_range, measured, part), index="recv_seq")


def laid_out(rows: DataFrame, by_range: bool) -> DataFrame:
    """Packets in the order that their files keep: by ``index``, or, where the partitions are not ranges of it, equal long texts
    next to each other first.  The codec then stores a text that many packets carry about once.
    """
    if by_range:
        return rows.sortWithinPartitions("index")
    long_text = F.when(F.col("length") >= LONG_TEXT, F.xxhash64("payload_utf8"))
    return rows.sortWithinPartitions(long_text.asc_nulls_first(), "index")


TABLE_VERSION = 1  # bump when the table layout changes


def _code_version() -> str:
    """Source text of the modules that decide the table's values."""
    import hashlib

    from ..functions import payload, saturate
    from ..operators import joins, normalise

    h = hashlib.sha1()
    for mod in (payload, saturate, joins, normalise):
        with open(mod.__file__, "rb") as f:
            h.update(f.read())
    with open(__file__, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


_table_lock = threading.Lock()


def packets_path(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the fixture's ``packets`` written once as a table, then scanned.

    This is the shape of the system: capture is ingested into one stored table
    and every query scans that table.  It is written under the shared folder
    named by ``spark.checkpoint.dir``, range-partitioned and sorted by
    ``index`` so that each file covers one index range: a cursor (``index >
    n``) or a lookup (``index = n``) skips files and row groups by their
    min/max statistics, and conditions reach the Parquet reader as pushed
    filters.  With documents too big to broadcast, the files that hold them are laid out
    by text (``laid_out``).  The key changes whenever the input tables change.
    """
    sources = [os.path.join(sf_dir, f"{t}.parquet") for t in ("events", "documents")]
    key = storage.fingerprint(spark, sources, extra=_code_version())
    path = os.path.join(checkpoint_dir(spark), "packetlake-tables", f"packets-v{TABLE_VERSION}-{key}")
    with _table_lock:
        if not storage.exists(spark, os.path.join(path, "_SUCCESS")):
            # Written aside and renamed into place: a concurrent writer of the
            # same table never sees (or deletes) a half-written folder.
            tmp = f"{path}.tmp-{uuid.uuid4().hex}"
            measured = document_size(spark, sf_dir)
            by_range = fits(*measured)
            for part in [None] if by_range else range(DOCUMENT_PARTS):
                # The shuffle files of a part go before those of the next come.
                with shuffles_freed(spark):
                    (laid_out(packets(spark, sf_dir, by_range=True, measured=measured, part=part), by_range)
                     .write.mode("append").option("compression", storage.PAYLOAD_CODEC).parquet(tmp))
            if not storage.rename(spark, tmp, path):
                storage.delete(spark, tmp)
    return path


def packets_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's stored ``packets`` table."""
    return spark.read.schema(PACKET_SCHEMA).parquet(packets_path(spark, sf_dir))


def packets_index(spark: SparkSession, sf_dir: str) -> FileIndex:
    """The stored table with its file index, built on first use."""
    path = packets_path(spark, sf_dir)
    index = FileIndex(spark, path, f"{path}-files")
    with _table_lock:
        return index if index.built() else index.build()
