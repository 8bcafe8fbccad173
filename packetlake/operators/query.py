"""Queries over the ``packets`` table: feeds, filters, full SQL, lookups.

Two ways of asking, chosen by the text itself (``customized``):

* Mode A – a bare condition: ``WHERE (<cond>) AND index > cursor``, 12 columns,
  ordered by ``index``.  The condition is parsed as a Spark SQL expression and
  applied as a DataFrame filter *before* the projection, so it may read the
  payload columns, and Catalyst pushes what it can into the scan.
* Mode B – a full ``SELECT`` (or ``WITH``): run by ``spark.sql`` with a view
  named ``packets``; its result must expose the 12 columns, the cursor
  predicate and the ordering are added as DataFrame operations on top.

A packet source is either a DataFrame or a callable ``session -> DataFrame``;
either way user SQL runs in a session of its own (``USER_SQL_CONF``), so that the
answer does not depend on the kind of source, and concurrent feeds and the
caller's own views never see each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TARGET_COLS
from ..session import prepare
from .joins import bounded_broadcast_join

PacketSource = Union[DataFrame, Callable[[SparkSession], DataFrame]]

VIEW_NAME = "packets"
# Settings of the sessions in which user SQL runs: "pname" is a column there.
USER_SQL_CONF = {"spark.sql.ansi.doubleQuotedIdentifiers": "true"}


def _frame(source: PacketSource, base: SparkSession | None = None) -> DataFrame:
    """The packets of a source in a fresh user-SQL session.

    They are also the session's ``packets`` view, so a subquery
    inside a condition (``index IN (SELECT … FROM packets …)``) reads them.
    """
    df = _moved(source) if isinstance(source, DataFrame) else source(sql_session(base or SparkSession.active()))
    df.createOrReplaceTempView(VIEW_NAME)
    return df


def _moved(df: DataFrame) -> DataFrame:
    """The same rows in a fresh user-SQL session, through a global view that is gone afterwards."""
    spark, name = df.sparkSession, f"packets_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return sql_session(spark).table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def _speaks_user_sql(spark: SparkSession) -> bool:
    return all(spark.conf.get(key, None) == value for key, value in USER_SQL_CONF.items())


def _after(df: DataFrame, after: int | None) -> DataFrame:
    """``index > after``; ``None`` means from the first row (row 0 included)."""
    return df if after is None else df.filter(F.col("index") > F.lit(int(after)))


# P1
def all_packets(packets: DataFrame) -> DataFrame:
    return packets


# P2
def project_no_payload(packets: DataFrame) -> DataFrame:
    return packets.select(*TARGET_COLS)


# P3 + L1
def since_index(packets: DataFrame, after: int | None) -> DataFrame:
    return _after(packets, after).orderBy("index")


def _ordered(df: DataFrame, ordered: bool) -> DataFrame:
    """ORDER BY index, unless the caller sorts a larger result itself."""
    return df.orderBy("index") if ordered else df


# The default feed
def since_index_no_payload(packets: DataFrame, after: int | None, ordered: bool = True) -> DataFrame:
    return _ordered(_after(packets, after).select(*TARGET_COLS), ordered)


def is_blank(text: str | None) -> bool:
    return text is None or not text.strip()


# P5 + P6
def condition_filter(packets: DataFrame, condition: str | None, after: int | None = None,
                     ordered: bool = True) -> DataFrame:
    """Mode A.  A blank condition keeps every row (``1=1``)."""
    df = packets
    if not is_blank(condition):
        if not (packets.isStreaming or _speaks_user_sql(packets.sparkSession)):
            df = _frame(packets)
        df = df.filter(plain_backslashes(condition.strip()))
    return _ordered(_after(df, after).select(*TARGET_COLS), ordered)


def plain_backslashes(sql: str) -> str:
    """User SQL in which a backslash in a string is a backslash: 'C:\\temp' has no tab.

    A quote in a string is written twice.  In a LIKE pattern a backslash escapes the next character.
    """
    return sql.replace("\\", "\\\\")


def clean_full_sql(sql: str) -> str:
    """Trim, then cut trailing ``;`` and spaces (the statement is nested)."""
    return sql.strip().rstrip("; ")


def sql_session(base: SparkSession) -> SparkSession:
    """A fresh session for user SQL, with the library settings applied."""
    iso = base.newSession()
    prepare(iso)
    for key, value in USER_SQL_CONF.items():
        iso.conf.set(key, value)
    return iso


def run_user_sql(source: PacketSource, sql: str, base: SparkSession | None = None,
                 session: SparkSession | None = None) -> DataFrame:
    """The user's statement as a DataFrame over a private ``packets`` view.

    ``session`` reuses a session made by ``sql_session`` (one per feed).
    """
    if isinstance(source, DataFrame):
        session = _frame(source).sparkSession
    else:
        session = session or sql_session(base or SparkSession.active())
        source(session).createOrReplaceTempView(VIEW_NAME)
    return session.sql(plain_backslashes(clean_full_sql(sql)))


# P7
def full_select(source: PacketSource, sql: str, after: int | None = None,
                base: SparkSession | None = None, session: SparkSession | None = None,
                ordered: bool = True) -> DataFrame:
    """Mode B: ``SELECT <12> FROM (<sql>) AS user_view WHERE index > n ORDER BY index``.

    The 12-column contract is enforced by the ``select``: a result without one
    of them is refused at analysis time.
    """
    user_view = run_user_sql(source, sql, base, session)
    return _ordered(_after(user_view.select(*TARGET_COLS), after), ordered)


def is_full_select(text: str | None) -> bool:
    """Q7: lower-cased, trimmed text starts with ``select`` (``with`` too)."""
    head = (text or "").strip().lower()
    return head.startswith("select") or head.startswith("with")


# P8
def customized(source: PacketSource, user_sql: str | None, after: int | None = None,
               base: SparkSession | None = None) -> DataFrame:
    """Dispatch between Mode A and Mode B on the text of the filter."""
    if is_blank(user_sql):
        return since_index_no_payload(_frame(source, base), after)
    if is_full_select(user_sql):
        return full_select(source, user_sql, after, base)
    text = user_sql.strip()
    if text.startswith("("):
        # "(" may open a condition or a parenthesised SELECT: try the condition first.
        try:
            return condition_filter(_frame(source, base), text, after)
        except Exception:  # noqa: BLE001 – fall through to full SQL
            return full_select(source, text, after, base)
    return condition_filter(_frame(source, base), text, after)


# P9 + L2
def packet_by_index(packets: DataFrame, index: int) -> DataFrame:
    """One row with its payload (none: "Packet not found" for the caller).

    ``index = n`` reaches the Parquet scan as a pushed filter, so files and row
    groups whose min/max exclude ``n`` are skipped.
    """
    return packets.filter(F.col("index") == F.lit(int(index))).limit(1)


def lookup_many(packets: DataFrame, ids: DataFrame, id_col: str = "index") -> DataFrame:
    """P9 for many ids at once: semi join, ids broadcast only when measured small."""
    keys = ids.select(F.col(id_col).alias("_id")).distinct()
    hit = bounded_broadcast_join(packets, keys, "index", "_id", width=F.lit(8),
                                 salt=F.xxhash64("index"), how="left_semi")
    return hit


# L3
def offset(df: DataFrame, n: int, order_col: str = "index") -> DataFrame:
    """Rows after the first ``n`` in ``order_col`` order (the table's order).

    Spark's own ``OFFSET`` gathers every row into one partition.  For an
    integral key with distinct values the ``n``-th value is found by histogram
    selection (a few pruned scans of the key column) and the rest is a pushed
    filter; otherwise rows are numbered by the distributed plan of
    ``assign_index`` and filtered.
    """
    from .numbering import assign_index
    from .selection import INTEGRAL, Ties, nth_smallest

    if n <= 0:
        return df.orderBy(order_col)
    if isinstance(df.schema[order_col].dataType, INTEGRAL):
        nulls = df.filter(F.col(order_col).isNull()).count()      # they come first
        try:
            if n < nulls:
                raise Ties(f"{nulls} rows have no {order_col}")
            first_kept = nth_smallest(df, order_col, int(n) - nulls)
        except Ties:
            first_kept = "ties"
        if first_kept is None:
            return df.limit(0)
        if first_kept != "ties":
            return df.filter(F.col(order_col) >= F.lit(first_kept)).orderBy(order_col)
    ranked = assign_index(df, order_col=order_col, out="_rank")
    return ranked.filter(F.col("_rank") >= F.lit(int(n))).drop("_rank").orderBy(order_col)


# U1 helper: same rows as "SELECT * … WHERE a UNION SELECT * … WHERE b" when
# the table's ``index`` is unique, with one scan and no de-duplication shuffle.
def union_by_index(packets: DataFrame, conditions: list[str], after: int | None = None) -> DataFrame:
    cond = " OR ".join(f"({c})" for c in conditions)
    return condition_filter(packets, cond, after)


# A1
def delivered_count(delivered: DataFrame) -> DataFrame:
    return delivered.agg(F.count(F.lit(1)).alias("delivered"))
