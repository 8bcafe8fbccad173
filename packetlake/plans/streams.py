"""Registered queries of the streaming operators, each with its oracle.

The given tables are captured once per input: the raw events become frames that
arrive in ``TICKS`` parts, each taken by one run of the capture query
(``availableNow``), so a part is one micro-batch and every run but the first
resumes from the checkpoint.  One run fails once and is restarted, one feed is
away for two ticks.  The queries read what the capture left: the store, its
side tables, its manifests and what the feeds delivered.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import query as Q
from ..operators import verify as V
from ..schema import TARGET_COLS
from ..session import checkpoint_dir, prepare, shuffles_freed
from ..sources import fixtures, storage
from ..sources import frames as FR
from ..streaming import feed as feeds
from ..streaming import store as stores
from ..streaming.summaries import Summary
from . import oracle as O
from .catalog import hexed, register, source

TICKS = 4
FAILING_TICK = 2              # its first run fails before it stores anything
AWAY = (1, 2)                 # ticks that the feed "resumed" is not there for
CONDITION = "pname = 'curl' AND length > 1000"
PORTS = "dst_port IN (80, 443)"
SNAPSHOT = "SELECT * FROM packets WHERE length > (SELECT avg(length) FROM packets)"
# The same with the mean kept up batch by batch.
TOTALS = {"totals": Summary({"mean_length": ("avg", "length")})}
KEPT_UP = "SELECT * FROM packets WHERE length > (SELECT mean_length FROM totals)"
# Beside its event, event e % 10 = 0 sends a heartbeat, 1 a log line, 2 a frame without a member.
EXTRAS = [FR.KIND_HEARTBEAT, FR.KIND_LOG, "none"]


@dataclass(frozen=True)
class Capture:
    root: str
    store: stores.PacketStore

    @property
    def frames(self) -> str:
        return os.path.join(self.root, "frames", "*")

    @property
    def streamed(self) -> str:
        return os.path.join(self.root, "streamed")

    def feed(self, spark: SparkSession, name: str) -> feeds.Feed:
        return feeds.Feed(self.store, name, {"all": None, "web": CONDITION, "resumed": PORTS, "above_average": SNAPSHOT,
                                              "above_mean": KEPT_UP}[name],
                          spark=spark, summaries=TOTALS if name == "above_mean" else None)


def tick_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of all parts: events with their extra frames, and the ``tick`` whose share of the ids holds the event's."""
    raw = fixtures.raw_events(spark, sf_dir).where("recv_seq IS NOT NULL")
    ids = fixtures.table(spark, sf_dir, "events").agg((F.max("event_id") + 1).alias("_ids"))   # one row
    extra = F.when(F.col("recv_seq") % 10 == 0, F.lit(EXTRAS[0]))
    for i, member in enumerate(EXTRAS[1:], 1):
        extra = extra.when(F.col("recv_seq") % 10 == i, F.lit(member))
    rows = (FR.events_as_frame_rows(raw).withColumn("_at", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("member", F.when(F.col("_at") == 0, F.col("member")).otherwise(extra)).where("member IS NOT NULL"))
    frames = FR.encode_frames(rows.withColumn("count", (F.col("pid") - 1075) * 30000000).withColumn("message", F.col("pname"))
                              .withColumn("log_info", F.col("uuid")).withColumn("recv_seq", F.col("recv_seq") * 2 + F.col("_at")))
    event = F.shiftright("recv_seq", 1)
    return (frames.join(F.broadcast(ids)).withColumn("tick", F.call_function("div", event * TICKS, F.col("_ids"))).drop("_ids")
            .where(F.col("tick").between(0, TICKS - 1)))


def _send(spark: SparkSession, root: str, made: str, tick: int) -> None:
    """One part arrives: its folder is renamed into the watched one; a part without frames is an empty file."""
    folder = os.path.join(root, "frames", f"tick-{tick}")
    part = os.path.join(made, f"tick={tick}")
    if not storage.exists(spark, part):
        spark.createDataFrame([], FR.FRAME_SCHEMA).write.parquet(folder)
        return
    storage.make_folder(spark, os.path.join(root, "frames"))
    if not storage.rename(spark, part, folder):
        raise OSError(f"could not move {part}")


def _run_ticks(spark: SparkSession, sf_dir: str, root: str) -> None:
    made = Capture(root, stores.PacketStore(os.path.join(root, "store")))
    every = [made.feed(spark, n) for n in ("all", "web", "resumed", "above_average", "above_mean")]
    failed = []

    def fail_once(batch: DataFrame, batch_id: int) -> None:
        if batch_id == FAILING_TICK and not failed:
            failed.append(batch_id)
            raise RuntimeError("injected failure of a tick")

    parts = os.path.join(root, "frames-made")     # derived in one job: the documents are joined once for all ticks
    (tick_frames(spark, sf_dir).write.partitionBy("tick").option("compression", storage.PAYLOAD_CODEC).parquet(parts))
    for tick in range(TICKS):
        _send(spark, root, parts, tick)
        here = [f for f in every if f.name != "resumed" or tick not in AWAY]
        feeds.run_with_restarts(lambda: feeds.start_capture(
            FR.frame_source(spark, made.frames, stream=True), made.store, here, os.path.join(root, "_capture"),
            available_now=True, on_batch=fail_once))
        (feeds.condition_stream(spark, made.store, CONDITION).writeStream.format("parquet").trigger(availableNow=True)
         .option("checkpointLocation", os.path.join(root, "_streamed")).start(made.streamed).awaitTermination())
    feeds.compact_deliveries(spark, made.store, TICKS - 2)     # the last tick's folders are read beside the folded ones


_lock = threading.Lock()


def capture(spark: SparkSession, sf_dir: str) -> Capture:
    """The capture of a folder's tables, made on first use under ``spark.checkpoint.dir``."""
    prepare(spark)
    code = hashlib.sha1()
    for path in (__file__, feeds.__file__, stores.__file__, FR.__file__, fixtures.__file__):
        with open(path, "rb") as f:
            code.update(f.read())
    sources = [os.path.join(sf_dir, f"{t}.parquet") for t in ("events", "documents")]
    key = storage.fingerprint(spark, sources, extra=code.hexdigest())
    folder = os.path.join(checkpoint_dir(spark), "packetlake-tables")
    made = os.path.join(folder, f"capture-{key}.path")       # names the folder of a complete capture
    with _lock:
        root = storage.read_text(spark, made)
        if root is None:
            root = os.path.join(folder, f"capture-{key}-{uuid.uuid4().hex}")
            with shuffles_freed(spark):
                _run_ticks(spark, sf_dir, root)
            storage.write_text(spark, made, root)
    return Capture(root, stores.PacketStore(os.path.join(root, "store")))


def over_ticks(body: str) -> str:
    """A statement over ``ticks``: the packets with the batch that brought them."""
    return O.PACKETS_CTE + f""", ticks AS (
  SELECT *, index * {TICKS} // (SELECT max(event_id) + 1 FROM events) AS batch_id FROM packets)
""" + body


def _delivered(name: str):
    return lambda spark, sf: capture(spark, sf).feed(spark, name).delivered(spark)


# The stored frames, read back and decoded.
register("frame_source", O.over_packets(
    "SELECT index * 2 AS recv_seq, timestamp, uuid, pname, length, "
    "CASE WHEN octet_length(payload_binary) > 0 THEN hex(payload_binary) ELSE hex(encode(payload_utf8)) END AS payload FROM packets"))(
    lambda spark, sf: FR.route_events(FR.decode_frames(FR.frame_source(spark, capture(spark, sf).frames))).select(
        "recv_seq", "timestamp", "uuid", "pname", "length", F.hex("payload").alias("payload")))

# The table that the batches appended to.
register("append_batch", O.over_packets(f"SELECT {O.ALL_HEX} FROM packets"))(
    lambda spark, sf: hexed(capture(spark, sf).store.packets(spark)))

# What each micro-batch committed.
register("micro_batch", over_ticks(
    "SELECT batch_id, min(index) AS first_index, count(*) AS n_rows FROM ticks GROUP BY batch_id"))(
    lambda spark, sf: capture(spark, sf).store.batches(spark))


# The side tables.
def _side(spark: SparkSession, sf: str) -> DataFrame:
    store, empty = capture(spark, sf).store, F.lit(None)
    columns = ["kind", "batch_id", "recv_seq", "count", "message", "log_info", "error"]
    found = [store.side(spark, t).withColumn("kind", F.lit(k)) for t, k in
             (("heartbeats", FR.KIND_HEARTBEAT), ("process_logs", FR.KIND_LOG), ("bad_frames", FR.KIND_ERROR))]
    types = {"recv_seq": "bigint", "count": "int"}
    out = None
    for df in found:
        part = df.select(*[F.col(c) if c in df.columns else empty.cast(types.get(c, "string")).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return out.drop("recv_seq")


register("side_tables", over_ticks(
    "SELECT CASE index % 10 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'process_log' ELSE 'error' END AS kind, batch_id, "
    "CASE WHEN index % 10 = 0 THEN cast(least(greatest((cast(pid AS bigint) - 1075) * 30000000, -2147483648), 2147483647) AS int) END AS count, "
    "CASE WHEN index % 10 = 0 THEN pname END AS message, CASE WHEN index % 10 = 1 THEN uuid END AS log_info, "
    "CASE WHEN index % 10 = 2 THEN 'no payload member is set' END AS error FROM ticks WHERE index % 10 < 3"))(_side)

# What the feeds were given, with the tick that gave it.
register("incremental_feed", over_ticks(f"SELECT {O.TARGET}, batch_id FROM ticks"))(_delivered("all"))
register("deliver", over_ticks(f"SELECT {O.TARGET}, batch_id FROM ticks WHERE {CONDITION}"))(_delivered("web"))

# The feed that was away gets what it missed when it is back.
register("cursor_resume", over_ticks(
    f"SELECT {O.TARGET}, CASE WHEN batch_id IN {AWAY} THEN {max(AWAY) + 1} ELSE batch_id END AS batch_id FROM ticks WHERE {PORTS}"))(
    _delivered("resumed"))

# T4: the condition as a streaming query of its own over the store's files.
register("feed_stateless", over_ticks(f"SELECT {O.TARGET}, batch_id FROM ticks WHERE {CONDITION}"))(
    lambda spark, sf: spark.read.parquet(capture(spark, sf).streamed))


# T5: a statement over all history at each tick, cut by the cursor.
def _snapshot_oracle() -> str:
    steps, before = [], "(SELECT -1)"
    for k in range(TICKS):
        steps.append(f"d{k} AS (SELECT index, cast({k} AS bigint) AS tick FROM ticks WHERE batch_id <= {k} "
                     f"AND length > (SELECT avg(length) FROM ticks WHERE batch_id <= {k}) AND index > {before})")
        so_far = " UNION ALL ".join(f"SELECT index FROM d{i}" for i in range(k + 1))
        before = f"(SELECT coalesce(max(index), -1) FROM ({so_far}))"
    every = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(TICKS))
    return over_ticks(", " + ", ".join(steps) + f" SELECT {O.TARGET}, tick AS batch_id FROM ({every}) JOIN packets USING (index)")


register("feed_snapshot", _snapshot_oracle())(_delivered("above_average"))
# The same feed from summaries: a tick reads its batch and the state, not the history.
register("feed_summaries", _snapshot_oracle())(_delivered("above_mean"))

def _runs(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """Rows and cursor of every tick of the feeds, from the rows they were given; only which ticks ran is the store's record."""
    store = capture(spark, sf).store
    ran = store.manifest(spark).where(F.col("feed").isin(*names)).select("feed", "batch_id")
    given = (feeds.deliveries(spark, store).where(F.col("feed").isin(*names)).groupBy("feed", "batch_id")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.max("index").alias("last")))
    so_far = Window.partitionBy("feed").orderBy("batch_id")
    return ran.join(given, ["feed", "batch_id"], "left").select(
        "feed", "batch_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.max("last").over(so_far).alias("cursor"))


# Every tick of every feed, the ones that delivered nothing too.
_RUNS = ", ".join(f"('{f}', cast({k} AS bigint))" for f in ("all", "web", "resumed") for k in range(TICKS)
                  if f != "resumed" or k not in AWAY)
register("feed_trigger", over_ticks(f"""
, given AS (SELECT 'all' AS feed, batch_id, index FROM ticks
  UNION ALL SELECT 'web', batch_id, index FROM ticks WHERE {CONDITION}
  UNION ALL SELECT 'resumed', CASE WHEN batch_id IN {AWAY} THEN {max(AWAY) + 1} ELSE batch_id END, index FROM ticks WHERE {PORTS}),
runs(feed, batch_id) AS (VALUES {_RUNS})
SELECT r.feed, r.batch_id, count(g.index) AS n_rows, max(max(g.index)) OVER (PARTITION BY r.feed ORDER BY r.batch_id) AS cursor
FROM runs r LEFT JOIN given g ON g.feed = r.feed AND g.batch_id = r.batch_id GROUP BY r.feed, r.batch_id"""))(
    lambda spark, sf: _runs(spark, sf, ["all", "web", "resumed"]))

# A2: ticks that delivered something.
register("tick_count", over_ticks(
    f"SELECT batch_id, count(*) AS n_rows, max(index) AS cursor FROM ticks WHERE {CONDITION} GROUP BY batch_id"))(
    lambda spark, sf: capture(spark, sf).feed(spark, "web").ticks(spark))

# The tick that failed and was run again left each packet once.
register("reconnect", over_ticks(
    "SELECT batch_id, count(*) AS n_rows, count(DISTINCT uuid) AS n_events FROM ticks GROUP BY batch_id"))(
    lambda spark, sf: stores.read_partitioned(
        spark, capture(spark, sf).store.path("packets"), stores.with_columns(stores.PACKET_SCHEMA, stores.BATCH_ID))
    .groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("uuid").alias("n_events")))


# V1: filters as they are judged, and what the accepted ones find.
FILTERS = [("condition", CONDITION), ("statement", "SELECT * FROM packets WHERE dst_port = 443"),
           ("unknown column", "no_such_column = 1"), ("columns left out", "SELECT index FROM packets"),
           ("ordered condition", "pname = 'curl' ORDER BY index"), ("broken", "pname LIKE")]


def _count(spark: SparkSession, sf: str, text: str | None) -> DataFrame:
    return Q.delivered_count(Q.customized(source(sf), text, None, base=spark))


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    out = None
    for name, text in FILTERS:
        accepted = V.verify_filter(spark, text) is None
        rows = _count(spark, sf, text if accepted else "1 = 0").select(
            F.lit(name).alias("filter"), F.lit(accepted).alias("accepted"), F.col("delivered").alias("n_rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


register("verify_filter", O.over_packets(
    "SELECT * FROM (VALUES ('unknown column', false, 0::bigint), ('columns left out', false, 0), ('ordered condition', false, 0), "
    "('broken', false, 0)) AS refused(filter, accepted, n_rows) "
    f"UNION ALL SELECT 'condition', true, count(*) FROM packets WHERE {CONDITION} "
    "UNION ALL SELECT 'statement', true, count(*) FROM packets WHERE dst_port = 443"))(_verified)


# V2: the delivered columns, their types, and how many values each holds.
def _delivered_schema(spark: SparkSession, sf: str) -> DataFrame:
    rows = capture(spark, sf).feed(spark, "all").delivered(spark).select(*TARGET_COLS)
    counts = rows.agg(*[F.count(c).alias(c) for c in TARGET_COLS])
    parts = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("n_values"))
             for f in rows.schema.fields]
    return counts.select(F.explode(F.array(*parts)).alias("c")).select("c.name", "c.type", "c.n_values")


_TYPES = {"uuid": "string", "src_ip": "string", "dst_ip": "string", "pname": "string", "pid": "int", "is_binary": "boolean"}
register("delivered_schema", O.over_packets(" UNION ALL ".join(
    f"SELECT '{c}' AS name, '{_TYPES.get(c, 'bigint')}' AS type, count({c}) AS n_values FROM packets" for c in O.TARGET.split(", "))))(
    _delivered_schema)

# V3: a filter is checked when its text changes; what each setting then finds.
CHANGES = [None, CONDITION, CONDITION, PORTS, SNAPSHOT, SNAPSHOT]


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    setting, out = V.FilterSetting(prepare(spark)), None
    for step, text in enumerate(CHANGES):
        setting.set(text)
        rows = _count(spark, sf, setting.text).select(
            F.lit(step).alias("step"), F.lit(setting.checks).alias("checks"), F.lit(setting.row_local).alias("row_local"),
            F.col("delivered").alias("n_rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


register("verify_on_change", O.over_packets(
    "SELECT step, checks, row_local, (CASE what WHEN 0 THEN (SELECT count(*) FROM packets) "
    f"WHEN 1 THEN (SELECT count(*) FROM packets WHERE {CONDITION}) WHEN 2 THEN (SELECT count(*) FROM packets WHERE {PORTS}) "
    "ELSE (SELECT count(*) FROM packets WHERE length > (SELECT avg(length) FROM packets)) END) AS n_rows "
    "FROM (VALUES (0, 0, true, 0), (1, 1, true, 1), (2, 1, true, 1), (3, 2, true, 2), (4, 3, false, 3), (5, 3, false, 3)) "
    "AS c(step, checks, row_local, what)"))(_changes)
