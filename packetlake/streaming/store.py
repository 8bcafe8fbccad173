"""The ``packets`` store – one Parquet partition per micro-batch.

Layout under a root folder every executor can reach::

    packets/batch_id=<id>/             numbered rows of the batch (14 columns)
    side/batch_id=<id>/kind=<kind>/    heartbeats, process logs, bad frames
    manifest/batch_id=<id>/manifest.json  the batch's commit record: one line
                                       for the store (first index, rows) and
                                       one per feed (rows delivered, cursor)

Every write touches exactly one ``batch_id`` partition (packets are written
beside the table and renamed into it once complete), and the manifest is
written last, so a batch that is run again after a failure (same
input, same ``batch_id``) writes the same rows with the same numbers:
effectively exactly-once.  The next free index is read from the previous
batch's manifest (O(1) per batch), not from a counter in memory.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.saturate import saturate_int32
from ..operators.normalise import events_to_packets
from ..operators.numbering import number_by_key
from ..schema import BAD_FRAME_SCHEMA, HEARTBEAT_SCHEMA, PACKET_SCHEMA, PROCESS_LOG_SCHEMA
from ..sources import storage

STORE_ROW = ""  # ``feed`` value of the store's own manifest row
OK, FAILED = "ok", "failed"  # ``state`` of a feed's manifest row
MANIFEST_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType(), False),
    T.StructField("first_index", T.LongType(), True),
    T.StructField("n_rows", T.LongType(), False),
    T.StructField("cursor", T.LongType(), True),
    T.StructField("state", T.StringType(), True),
])
SIDE_SCHEMA = T.StructType([
    T.StructField("recv_seq", T.LongType(), True),
    T.StructField("n_bytes", T.LongType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("count", T.IntegerType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("log_info", T.StringType(), True),
])
SIDE_TABLES = {"heartbeats": ("heartbeat", HEARTBEAT_SCHEMA), "process_logs": ("process_log", PROCESS_LOG_SCHEMA),
               "bad_frames": ("error", BAD_FRAME_SCHEMA)}


def with_columns(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType(schema.fields + list(fields))


BATCH_ID = T.StructField("batch_id", T.LongType(), True)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A partitioned folder with an explicit schema; empty if absent."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


class PacketStore:
    """Append-only packet table plus side tables, partitioned by ``batch_id``."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, table: str, batch_id: int | None = None) -> str:
        base = os.path.join(self.root, table)
        return base if batch_id is None else os.path.join(base, f"batch_id={int(batch_id)}")

    # -------------------------------------------------------------- reading
    def packets(self, spark: SparkSession, upto_batch: int | None = None) -> DataFrame:
        """The ``packets`` table (14 columns) as of a batch (default: all).

        After ``consolidate``, batches up to the consolidated one come from the
        history table and only the later batch folders are read.  Up to a given batch they are
        read by path, so the listing no longer grows with every batch ever written, and a batch folder
        missing among them is an error.
        """
        current = self.history(spark)
        if current is not None and upto_batch is not None and current["upto"] <= upto_batch:
            parts = [spark.read.schema(PACKET_SCHEMA).parquet(current["path"])]
            later = [self.path("packets", b) for b in range(current["upto"] + 1, int(upto_batch) + 1)]
            if later:
                parts.append(spark.read.schema(PACKET_SCHEMA).parquet(*later))
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out
        df = read_partitioned(spark, self.path("packets"), with_columns(PACKET_SCHEMA, BATCH_ID))
        if upto_batch is not None:
            df = df.filter(F.col("batch_id") <= F.lit(int(upto_batch)))
        elif current is not None:
            later = df.filter(F.col("batch_id") > F.lit(int(current["upto"]))).drop("batch_id")
            return spark.read.schema(PACKET_SCHEMA).parquet(current["path"]).unionByName(later)
        return df.drop("batch_id")

    def history(self, spark: SparkSession) -> dict | None:
        """The current consolidated history: ``{"upto": batch id, "path": folder}``."""
        text = storage.read_text(spark, os.path.join(self.root, "history", "CURRENT"))
        return json.loads(text) if text else None

    def consolidate(self, spark: SparkSession, upto_batch: int) -> str:
        """Fold the committed batches up to ``upto_batch`` into one history table.

        Runs beside the capture query.  The new table is written completely
        (range-partitioned and sorted by ``index``, so files hold disjoint index
        ranges), then the ``CURRENT`` pointer is switched by one rename; readers
        see the old or the new history, never a part.  Each run writes a folder of its
        own, so it never overwrites the one it reads.  Batch folders stay as
        they are (they are what a replayed batch overwrites).
        """
        if self.manifest_rows(spark, upto_batch) is None:
            raise ValueError(f"batch {upto_batch} is not committed")
        path = os.path.join(self.root, "history", f"upto={int(upto_batch)}-{uuid.uuid4().hex}")
        rows = self.packets(spark, upto_batch)
        rows.repartitionByRange("index").sortWithinPartitions("index").write.mode("overwrite").option("compression", storage.PAYLOAD_CODEC).parquet(path)
        storage.write_text(spark, os.path.join(self.root, "history", "CURRENT"),
                           json.dumps({"upto": int(upto_batch), "path": path}))
        return path

    def batch_packets(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The rows one batch appended (one partition, read directly)."""
        return read_partitioned(spark, self.path("packets", batch_id), PACKET_SCHEMA)

    def batches(self, spark: SparkSession) -> DataFrame:
        """(batch_id, first_index, n_rows) of the batches that brought rows, from the packets themselves."""
        rows = read_partitioned(spark, self.path("packets"), with_columns(PACKET_SCHEMA, BATCH_ID))
        return rows.groupBy("batch_id").agg(F.min("index").alias("first_index"), F.count(F.lit(1)).alias("n_rows"))

    def side(self, spark: SparkSession, table: str) -> DataFrame:
        """``heartbeats``, ``process_logs`` or ``bad_frames``, with ``batch_id``."""
        kind, schema = SIDE_TABLES[table]
        df = read_partitioned(spark, self.path("side"),
                              with_columns(SIDE_SCHEMA, BATCH_ID, T.StructField("kind", T.StringType(), True)))
        return df.filter(F.col("kind") == kind).select(*[f.name for f in schema.fields], "batch_id")

    def manifest(self, spark: SparkSession) -> DataFrame:
        """All commit records, one row per (batch, store or feed)."""
        return read_partitioned(spark, self.path("manifest"), with_columns(MANIFEST_SCHEMA, BATCH_ID), "json")

    def manifest_rows(self, spark: SparkSession, batch_id: int) -> list | None:
        """Rows of one batch's manifest (a handful: store + feeds); None if absent."""
        if batch_id < 0:
            return None
        text = storage.read_text(spark, os.path.join(self.path("manifest", batch_id), "manifest.json"))
        if text is None:
            return None
        return [Row(**{"state": None} | json.loads(line)) for line in text.splitlines() if line.strip()]

    def next_index(self, spark: SparkSession, batch_id: int, prev_rows: list | None = None) -> int:
        """First free index for ``batch_id``: end of the latest earlier batch."""
        rows = prev_rows if prev_rows is not None else self.manifest_rows(spark, batch_id - 1)
        mine = [r for r in rows or [] if r["feed"] == STORE_ROW]
        if mine:
            return int(mine[0]["first_index"] + mine[0]["n_rows"])
        # No record for the previous id (first batch, or ids not consecutive):
        # fall back to all manifests before this batch – one small row each.
        if not storage.exists(spark, self.path("manifest")):
            return 0
        m = self.manifest(spark).filter((F.col("batch_id") < F.lit(int(batch_id))) & (F.col("feed") == STORE_ROW))
        row = m.agg(F.max(F.col("first_index") + F.col("n_rows")).alias("end")).first()
        return int(row["end"]) if row and row["end"] is not None else 0

    # -------------------------------------------------------------- writing
    def append_events(self, events: DataFrame, batch_id: int, base: int, size_hint: int | None = None) -> int:
        """Number decoded events from ``base`` in ``recv_seq`` order and write them.

        The rows are written to a staging folder that is then renamed to the
        batch's.  A replayed batch finds that folder complete and leaves it as it
        is: its files keep their names, so a stream over them sees each row once.

        ``events`` has ``recv_seq`` (unique, arrival order) and the decoded event
        columns with ``payload``.  Returns the number of rows, observed during
        the write.  The numbering spreads over ranges of ``recv_seq``, a file each.
        ``size_hint`` is an upper bound of the row count.
        """
        target = self.path("packets", batch_id)
        if storage.exists(spark := events.sparkSession, target):
            return self.batch_packets(spark, batch_id).count()
        numbered = number_by_key(events, "recv_seq", base=base, out="index", at_most=size_hint)
        obs = Observation(f"append_{batch_id}_{time.monotonic_ns()}")
        (events_to_packets(numbered).observe(obs, F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").option("compression", storage.PAYLOAD_CODEC).parquet(self.path("staging", batch_id)))
        n = int(obs.get["n"])
        storage.make_folder(spark, self.path("packets"))
        if not storage.rename(spark, self.path("staging", batch_id), target):
            raise OSError(f"could not commit {target}")
        return n

    def append_side(self, decoded: DataFrame, batch_id: int, n_side: int | None = None) -> None:
        """Heartbeats, process logs and bad frames of a decoded batch, one write.

        ``n_side = 0`` (known from the decoding pass) skips the write: a replay of
        the batch decodes the same frames and has no side rows either.
        """
        if n_side == 0:
            return
        side = decoded.filter(F.col("kind") != F.lit("event")).select(
            "recv_seq", "n_bytes", "error", F.col("hb_timestamp").alias("timestamp"),
            saturate_int32("hb_count").alias("count"), F.col("hb_message").alias("message"), "log_info", "kind")
        side.write.mode("overwrite").partitionBy("kind").parquet(self.path("side", batch_id))

    def write_manifest(self, spark: SparkSession, batch_id: int, rows: list[tuple]) -> None:
        """Commit record of a batch: (feed, first_index, n_rows, cursor, state) rows.

        A few lines, written by the driver straight to the shared file system
        (temp file + rename) – no Spark job for a handful of numbers.
        """
        names = [f.name for f in MANIFEST_SCHEMA.fields]
        text = "".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows)
        storage.write_text(spark, os.path.join(self.path("manifest", batch_id), "manifest.json"), text)
