"""Incremental feeds over the packet store, driven by one streaming query.

One Structured Streaming query is the single writer of the store.  For each
micro-batch (``foreachBatch``):

1. decode the frames (or take decoded events as they are), write the side
   tables, number the events after the previous batch and write them (S10);
2. for every feed: cursor := last index it delivered before this batch
   (``start_after`` if none); evaluate its filter – a Mode A condition on the
   batch's new rows, a Mode B statement over the whole stored history up to
   this batch (the reference's semantics: a row at or below the cursor that
   qualifies later is never delivered) – and keep ``index > cursor``.  A Mode B
   statement that only selects, filters and unions rows gives the same rows
   on the new batch alone and is evaluated there (``verify.is_row_local``).  A
   feed that did not run in the batch before (new, paused or failed) reads the
   store above its cursor, so it catches up on what it missed;
3. write what every feed delivers in one job, ``delivered/batch_id=<id>/feed=<name>``,
   each file sorted by index; rows and last index per feed are observed during
   that write (no second pass), then each consumer is called on its own;
4. write the batch's manifest (store row + one row per feed): the commit.

All writes overwrite one ``batch_id`` partition and every cursor is read from
the manifest, so a batch replayed after a crash (between any two steps)
neither loses nor duplicates rows.
"""

from __future__ import annotations

import json
import logging
import os
import re
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.query import (condition_filter, full_select, is_blank, is_full_select, plain_backslashes,
                               since_index_no_payload, sql_session)
from ..operators.verify import FilterSetting
from ..schema import PACKET_SCHEMA, TARGET_COLS, TARGET_SCHEMA
from ..sources import frames as FR
from ..sources import storage
from .store import BATCH_ID, FAILED, OK, STORE_ROW, PacketStore, read_partitioned, with_columns
from .summaries import Summary

log = logging.getLogger(__name__)

# Operating constants of the capture pipeline.
TICK = "300 milliseconds"          # flush / feed interval
RECONNECT_BACKOFF_S = 0.3          # wait before a failed query is restarted
LASTING_SQL_STATES = ("21", "22", "42")   # classes: cardinality, data, syntax or access rule
MAX_BACKOFF_S = 30.0               # longest wait between restarts

DELIVERED_SCHEMA = with_columns(TARGET_SCHEMA, BATCH_ID, T.StructField("feed", T.StringType(), True))


class Feed:
    """A named filter whose matching rows are delivered once each, in index order."""

    def __init__(self, store: PacketStore, name: str = "default", user_sql: str | None = None,
                 start_after: int | None = None, spark: SparkSession | None = None,
                 on_deliver: Callable[[DataFrame, int], None] | None = None,
                 summaries: dict[str, Summary] | None = None):
        """``summaries`` are views of the whole history that the statement may
        use by name; its ``packets`` are then the rows above the cursor, so that a
        tick reads the batch and the summaries' state, not the history.

        ``on_deliver(rows, batch_id)`` is called with each tick's rows (sorted
        by index) after they are written and before the batch commits.  A
        callback that fails is called again once; if it fails again the feed
        stops with its cursor unmoved, so a feed restarted from ``cursor()``
        hands the rows over again (at-least-once for the consumer)."""
        if not name or "/" in name or "=" in name:
            raise ValueError(f"bad feed name {name!r}")
        self.store = store
        self.name = name
        self.start_after = start_after
        self.on_deliver = on_deliver
        self.failure: str | None = None     # set when the feed failed at run time; it then stops
        self.summaries = summaries or {}
        self.setting = FilterSetting(spark or SparkSession.active(), summaries=self.summaries)
        self.setting.set(user_sql)          # V3: refused here if it cannot run
        self._sql_session: SparkSession | None = None

    def _session(self, spark: SparkSession) -> SparkSession:
        """The feed's own session for full SQL (its ``packets`` view is private)."""
        if self._sql_session is None or self._sql_session.sparkContext is not spark.sparkContext:
            self._sql_session = sql_session(spark)
        return self._sql_session

    @property
    def user_sql(self) -> str | None:
        return self.setting.text

    # ---------------------------------------------------------------- state
    def cursor_before(self, spark: SparkSession, batch_id: int, prev_rows: list | None) -> tuple[int | None, bool]:
        """(cursor, feed ran in the batch before) as of the start of ``batch_id``.

        Only a successful run in the batch just before means that nothing below
        ``batch_id`` is left to deliver.
        """
        if batch_id == 0:
            return self.start_after, True
        mine = [r for r in prev_rows or [] if r["feed"] == self.name]
        if mine:
            return mine[0]["cursor"], mine[0]["state"] != FAILED
        if not storage.exists(spark, self.store.path("manifest")):
            return self.start_after, False
        m = self.store.manifest(spark).filter((F.col("feed") == self.name) & (F.col("batch_id") < batch_id))
        row = m.orderBy(F.col("batch_id").desc()).select("cursor").limit(1).collect()
        return (row[0]["cursor"] if row else self.start_after), False

    def cursor(self, spark: SparkSession) -> int | None:
        """Last delivered index (survives stop/start); ``start_after`` if none."""
        m = self.store.manifest(spark).filter(F.col("feed") == self.name)
        row = m.orderBy(F.col("batch_id").desc()).select("cursor").limit(1).collect()
        return row[0]["cursor"] if row else self.start_after

    # ---------------------------------------------------------------- work
    def reads_history(self, history: bool) -> bool:
        """Whether this tick's evaluation reads more than the new batch."""
        return history or not self.setting.row_local

    def select(self, spark: SparkSession, batch_id: int, cursor: int | None, history: bool) -> DataFrame:
        """Rows this feed delivers for ``batch_id`` (12 columns, unsorted: the
        delivery sorts all feeds together)."""
        text = self.user_sql
        if self.summaries:
            return self._select_with_summaries(spark, batch_id, cursor)
        whole = lambda s: self.store.packets(s, upto_batch=batch_id)
        session = self._session(spark)
        if not is_blank(text) and is_full_select(text):
            if self.setting.row_local and not history:
                # Only selects, filters and unions: the new rows say it all.
                new = lambda s: self.store.batch_packets(s, batch_id)
                return full_select(new, text, cursor, session=session, ordered=False)
            return full_select(whole, text, cursor, session=session, ordered=False)    # T5
        # Mode A needs only the new rows (T4), unless the feed starts late or the
        # condition reads other rows through a subquery.
        if history or not self.setting.row_local:
            rows = whole(session)
            rows.createOrReplaceTempView("packets")   # for subqueries in the condition
        else:
            rows = self.store.batch_packets(session, batch_id)
        if is_blank(text):
            return since_index_no_payload(rows, cursor, ordered=False)
        return condition_filter(rows, text, cursor, ordered=False)

    # ---------------------------------------------------------------- summaries
    def _state_path(self, name: str, batch_id: int) -> str:
        return os.path.join(self.store.root, "summaries", self.name, name, f"batch_id={batch_id}")

    def _state(self, spark: SparkSession, name: str, summary: Summary, batch_id: int) -> DataFrame:
        """The partials of all rows up to ``batch_id``: the state of the batch before and this batch's rows.

        Only a feed that did not run in the batch before reads the history, once.
        """
        new = summary.partial(self.store.batch_packets(spark, batch_id))
        before = self._state_path(name, batch_id - 1)
        if batch_id > 0 and storage.exists(spark, os.path.join(before, "_SUCCESS")):
            state = summary.merge(spark.read.schema(new.schema).parquet(before), new)
        elif batch_id > 0:
            state = summary.partial(self.store.packets(spark, upto_batch=batch_id))
        else:
            state = new
        path = self._state_path(name, batch_id)
        state.coalesce(1 if not summary.keys else max(1, spark.sparkContext.defaultParallelism)).write.mode("overwrite").parquet(path)
        return spark.read.schema(new.schema).parquet(path)

    def _above(self, spark: SparkSession, batch_id: int, cursor: int | None) -> DataFrame:
        """The rows above the cursor, from the batches that hold any: known from their manifests, newest first."""
        first = batch_id
        while first > 0:
            mine = [r for r in self.store.manifest_rows(spark, first - 1) or [] if r["feed"] == STORE_ROW]
            if cursor is not None and mine and mine[0]["first_index"] + mine[0]["n_rows"] - 1 <= cursor:
                break
            first -= 1
        rows = spark.read.schema(PACKET_SCHEMA).parquet(*[self.store.path("packets", b) for b in range(first, batch_id + 1)])
        return rows if cursor is None else rows.filter(F.col("index") > F.lit(int(cursor)))

    def _select_with_summaries(self, spark: SparkSession, batch_id: int, cursor: int | None) -> DataFrame:
        session = self._session(spark)
        for name, summary in self.summaries.items():
            summary.finish(self._state(session, name, summary, batch_id)).createOrReplaceTempView(name)
        rows = lambda s: self._above(s, batch_id, cursor)
        if is_full_select(self.user_sql):
            return full_select(rows, self.user_sql, cursor, session=session, ordered=False)
        above = rows(session)
        above.createOrReplaceTempView("packets")
        return condition_filter(above, self.user_sql, cursor, ordered=False)

    # ---------------------------------------------------------------- output
    def delivered_in(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The rows one tick delivered, in index order."""
        folded = folded_deliveries(spark, self.store)
        if folded is not None and batch_id <= folded["upto"]:
            rows = self.delivered(spark).where(F.col("batch_id") == int(batch_id)).drop("batch_id")
        else:
            path = os.path.join(self.store.root, "delivered", f"batch_id={batch_id}", f"feed={self.name}")
            rows = read_partitioned(spark, path, TARGET_SCHEMA)
        return rows.orderBy("index")

    def delivered(self, spark: SparkSession) -> DataFrame:
        """Everything delivered so far, with the batch that delivered it."""
        return deliveries(spark, self.store).filter(F.col("feed") == self.name).drop("feed")

    def ticks(self, spark: SparkSession) -> DataFrame:
        """A2: rows and cursor per tick, from the delivered rows; ticks that delivered nothing are left out."""
        return self.delivered(spark).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("index").alias("cursor"))

    def deliver(self, spark: SparkSession, batch_id: int) -> tuple[int, int | None]:
        """Deliver this feed alone for an already stored batch (a late start).

        Only this feed's folder and manifest line of the batch are replaced;
        what other feeds delivered for the batch stays as it is.  A batch whose
        deliveries are folded (``compact_deliveries``) is refused.
        """
        folded = folded_deliveries(spark, self.store)
        if folded is not None and batch_id <= folded["upto"]:
            raise ValueError(f"the deliveries of batch {batch_id} are folded")
        prev = self.store.manifest_rows(spark, batch_id) or []
        others = [tuple(r[f] for f in ("feed", "first_index", "n_rows", "cursor", "state"))
                  for r in prev if r["feed"] != self.name]
        rows = deliver_feeds(spark, self.store, [self], batch_id, only_own_folder=True)
        self.store.write_manifest(spark, batch_id, others + rows)
        return rows[0][2], rows[0][3]


def folded_deliveries(spark: SparkSession, store: PacketStore) -> dict | None:
    """The folded deliveries: ``{"upto": batch id, "path": folder}``."""
    text = storage.read_text(spark, os.path.join(store.root, "delivered_history", "CURRENT"))
    return json.loads(text) if text else None


def deliveries(spark: SparkSession, store: PacketStore) -> DataFrame:
    """What all feeds were given: the folded table and the batch folders after it."""
    rows = read_partitioned(spark, os.path.join(store.root, "delivered"), DELIVERED_SCHEMA)
    folded = folded_deliveries(spark, store)
    if folded is None:
        return rows
    old = spark.read.schema(DELIVERED_SCHEMA).parquet(folded["path"])
    return old.unionByName(rows.filter(F.col("batch_id") > F.lit(int(folded["upto"]))))


def compact_deliveries(spark: SparkSession, store: PacketStore, upto_batch: int, remove: bool = False) -> str:
    """Fold the deliveries of the committed batches up to ``upto_batch`` into one table, a folder per feed.

    Runs beside the capture query.  A tick leaves a small file per feed; the folded table has files of the advised
    size, each with a range of one feed's indexes.  It is written whole and then named by one rename, so
    readers see the batch folders or the table, each row once.  With ``remove`` the
    folded batch folders and the table before are deleted afterwards; a reader that listed them earlier has to read again.
    """
    if store.manifest_rows(spark, upto_batch) is None:
        raise ValueError(f"batch {upto_batch} is not committed")
    before = folded_deliveries(spark, store)
    if before is not None and before["upto"] > upto_batch:
        raise ValueError(f"deliveries are folded up to batch {before['upto']}")
    path = os.path.join(store.root, "delivered_history", f"upto={int(upto_batch)}-{uuid.uuid4().hex}")
    (deliveries(spark, store).filter(F.col("batch_id") <= F.lit(int(upto_batch)))
     .repartitionByRange("feed", "index").sortWithinPartitions("feed", "index")
     .write.partitionBy("feed").parquet(path))
    storage.write_text(spark, os.path.join(store.root, "delivered_history", "CURRENT"),
                       json.dumps({"upto": int(upto_batch), "path": path}))
    if remove:
        for batch in range(before["upto"] + 1 if before is not None else 0, int(upto_batch) + 1):
            storage.delete(spark, os.path.join(store.root, "delivered", f"batch_id={batch}"))
        if before is not None and before["path"] != path:
            storage.delete(spark, before["path"])
    return path


def deliver_feeds(spark: SparkSession, store: PacketStore, feeds: list[Feed], batch_id: int,
                  only_own_folder: bool = False) -> list[tuple]:
    """Evaluate every feed for a batch and write all deliveries in one job.

    Returns the manifest rows (feed, None, rows delivered, new cursor, state).
    If the joint write fails, every feed is delivered on its own; a feed that
    fails alone too keeps its cursor, while the others go on.  If its statement or
    data is at fault it is marked (``Feed.failure``) and left out of later
    batches; after any other error the next batch tries again.  Consumers are called after
    the write, each on its own.
    """
    if not feeds:
        return []
    prev = store.manifest_rows(spark, batch_id - 1)
    before = {feed.name: feed.cursor_before(spark, batch_id, prev) for feed in feeds}
    try:
        rows = _deliver(spark, store, feeds, batch_id, before, only_own_folder)
    except Exception as exc:  # noqa: BLE001 – find the failing feed, keep the others
        log.warning("joint delivery of batch %d failed (%s); delivering feed by feed", batch_id, exc)
        rows = {}
        for feed in feeds:
            try:
                rows |= _deliver(spark, store, [feed], batch_id, before, only_own_folder=True)
            except Exception as alone:  # noqa: BLE001 – this feed stops, the others and the store go on
                rows[feed.name] = _failed(feed, batch_id, alone, before, _is_lasting(alone))
    for feed in feeds:
        if rows[feed.name][2] and feed.on_deliver is not None:
            error = _hand_over(spark, feed, batch_id)
            if error is not None:
                # The cursor stays, so the rows come again: they must not stand in this batch too.
                (spark.createDataFrame([], TARGET_SCHEMA).write.mode("overwrite")
                 .parquet(os.path.join(store.root, "delivered", f"batch_id={batch_id}", f"feed={feed.name}")))
                rows[feed.name] = _failed(feed, batch_id, error, before, lasting=True)
    return [rows[feed.name] for feed in feeds]


def _is_lasting(error: Exception) -> bool:
    """Whether the statement or its data is at fault, so that a retry would fail as well."""
    return any(state[:2] in LASTING_SQL_STATES for state in re.findall(r"SQLSTATE: (\w{5})", str(error)))


def _failed(feed: Feed, batch_id: int, error: Exception, before: dict, lasting: bool) -> tuple:
    """A failed feed's manifest row, with the cursor unmoved; a lasting failure stops the feed."""
    text = str(error).strip()
    reason = text.splitlines()[0] if text else type(error).__name__
    if lasting:
        feed.failure = reason
    log.error("feed %s %s at batch %d: %s", feed.name, "stopped" if lasting else "failed", batch_id, reason)
    return (feed.name, None, 0, before[feed.name][0], FAILED)


def _hand_over(spark: SparkSession, feed: Feed, batch_id: int) -> Exception | None:
    """Call a feed's consumer, once more if it fails; the second error, if any."""
    error = None
    for _ in range(2):
        try:
            feed.on_deliver(feed.delivered_in(spark, batch_id), batch_id)
            return None
        except Exception as exc:  # noqa: BLE001 – a consumer must not stop the others
            log.warning("consumer of feed %s failed at batch %d: %s", feed.name, batch_id, exc)
            error = exc
    return error


def _deliver(spark: SparkSession, store: PacketStore, feeds: list[Feed], batch_id: int,
             before: dict, only_own_folder: bool) -> dict[str, tuple]:
    parts, wide = [], False
    for feed in feeds:
        cursor, ran = before[feed.name]
        wide = wide or feed.reads_history(history=not ran)
        parts.append(feed.select(spark, batch_id, cursor, history=not ran)
                     .select(*TARGET_COLS).withColumn("feed", F.lit(feed.name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    obs = Observation(f"deliver_{batch_id}_{time.monotonic_ns()}")
    metrics = []
    for i, feed in enumerate(feeds):
        mine = F.col("feed") == feed.name
        metrics += [F.count(F.when(mine, 1)).alias(f"n{i}"), F.max(F.when(mine, F.col("index"))).alias(f"last{i}")]
    # A batch's files hold disjoint index ranges: sorting each is enough.  History is sorted as a whole.
    ordered = out.orderBy("feed", "index") if wide else out.sortWithinPartitions("feed", "index")
    # Observe above the sort: a range sort's sampling pass must not count rows twice.
    batch_dir = os.path.join(store.root, "delivered", f"batch_id={batch_id}")
    if only_own_folder:   # one feed: replace its folder only
        (ordered.observe(obs, *metrics).drop("feed")
         .write.mode("overwrite").parquet(os.path.join(batch_dir, f"feed={feeds[0].name}")))
    else:                 # every feed of the batch: replace the batch folder
        ordered.observe(obs, *metrics).write.mode("overwrite").partitionBy("feed").parquet(batch_dir)
    got = obs.get
    rows = {}
    for i, feed in enumerate(feeds):
        n = int(got[f"n{i}"])
        cursor = got[f"last{i}"] if n else before[feed.name][0]        # Q6: last *delivered* index
        rows[feed.name] = (feed.name, None, n, cursor, OK)
        log.info("feed %s batch %d: %d rows, cursor %s", feed.name, batch_id, n, cursor)
    return rows


def process_batch(store: PacketStore, feeds: list[Feed], batch: DataFrame, batch_id: int,
                  fail_after_append: bool = False) -> None:
    """The body of one micro-batch: append, deliver every feed, commit.

    ``batch`` holds frames (of any source, or of ``kafka_frames``) or decoded events.
    """
    spark = batch.sparkSession
    prev = store.manifest_rows(spark, batch_id - 1)
    base = store.next_index(spark, batch_id, prev)
    if "frame" in batch.columns:
        obs = Observation(f"decode_{batch_id}_{time.monotonic_ns()}")
        decoded = FR.decode_frames(FR.arrival_order(batch) if "offset" in batch.columns else batch).persist()
        try:
            # Fills the cache, bounds the event count and counts the side rows.
            n_frames = decoded.observe(obs, F.count(F.when(F.col("kind") != FR.KIND_EVENT, 1)).alias("side")).count()
            n = store.append_events(FR.route_events(decoded), batch_id, base, size_hint=n_frames)
            store.append_side(decoded, batch_id, n_side=int(obs.get["side"]))
        finally:
            decoded.unpersist()
    else:
        n = store.append_events(batch, batch_id, base)
    if fail_after_append:
        raise RuntimeError("injected failure between append and delivery")
    live = [f for f in feeds if f.failure is None]     # Q13: a failed feed stops alone
    rows = deliver_feeds(spark, store, live, batch_id)
    store.write_manifest(spark, batch_id, [(STORE_ROW, base, n, None, OK)] + rows)


def start_capture(source: DataFrame, store: PacketStore, feeds: list[Feed], checkpoint: str,
                  available_now: bool = False, tick: str = TICK,
                  on_batch: Callable[[DataFrame, int], None] | None = None):
    """The single streaming query that ingests and feeds.

    ``source`` is a streaming DataFrame of frames (``recv_seq``, ``frame``) or of
    decoded events; size each micro-batch at the source (``maxFilesPerTrigger``,
    ``maxOffsetsPerTrigger``).  ``available_now`` processes what is there and
    stops (tests, backfills).
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        if on_batch is not None:
            on_batch(batch, batch_id)
        process_batch(store, feeds, batch, batch_id)

    writer = source.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=tick)
    return writer.start()


def run_with_restarts(start: Callable[[], object], max_restarts: int | None = None,
                      backoff_s: float = RECONNECT_BACKOFF_S, stop: threading.Event | None = None):
    """On a failed query, wait and start it again from its checkpoint.

    Goes on until the query ends by itself or ``stop`` is set.  The wait doubles
    with every failure in a row up to ``MAX_BACKOFF_S``; a query that completed
    a batch begins a new row.  ``max_restarts`` bounds the failures in a row.
    """
    stop = stop or threading.Event()
    failures = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:  # noqa: BLE001 – StreamingQueryException and friends
            failures = 1 if query.recentProgress else failures + 1
            if max_restarts is not None and failures > max_restarts:
                raise
            wait = min(backoff_s * 2 ** min(failures - 1, 30), MAX_BACKOFF_S)
            log.warning("capture query failed; restart in %.1fs", wait)
            if stop.wait(wait):
                return query


def condition_stream(spark: SparkSession, store: PacketStore, condition: str | None,
                     after: int | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """T4: a Mode A feed as a native streaming query over the store's files.

    New ``packets`` files become new input; the condition and the cursor are
    plain streaming filters (append mode, no state).  Write it with any
    streaming sink – e.g. ``.writeStream.format("parquet")`` with its own
    checkpoint gives exactly-once delivery, decoupled from ingest: a batch's
    folder appears complete by one rename and a replayed batch leaves it as it
    is (on a store whose folder rename is atomic).  Rows of one
    micro-batch are not sorted: a streaming plan cannot sort appended rows.
    """
    reader = sql_session(spark).readStream.schema(with_columns(PACKET_SCHEMA, BATCH_ID))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    rows = reader.parquet(store.path("packets"))
    if not is_blank(condition):
        rows = rows.filter(plain_backslashes(condition.strip()))
    if after is not None:
        rows = rows.filter(F.col("index") > F.lit(int(after)))
    return rows.select(*TARGET_COLS, "batch_id")
