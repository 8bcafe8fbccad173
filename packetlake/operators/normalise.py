"""Decoded capture events → rows of the ``packets`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import classify
from ..functions.saturate import saturate_int32
from ..schema import PACKET_COLS


def events_to_packets(raw: DataFrame, index: str = "index") -> DataFrame:
    """Classify the payload, clamp ``pid`` to int32 and keep the 14 columns.

    ``raw`` holds the decoded event columns plus ``payload`` and a column named
    ``index`` (see ``operators.numbering.assign_index``, or any given key).
    ``length`` is taken as it came from the wire, not recomputed.
    """
    df = raw
    if index != "index":
        df = df.withColumn("index", F.col(index))
    df = df.withColumn("pid", saturate_int32("pid"))
    df = classify(df, "payload")
    return df.select(*PACKET_COLS)


def normalise_heartbeats(hb: DataFrame) -> DataFrame:
    """Heartbeat rows with ``count`` clamped to int32."""
    return (hb.withColumn("timestamp", F.col("timestamp").cast("bigint"))
            .withColumn("count", saturate_int32("count"))
            .withColumn("message", F.coalesce(F.col("message"), F.lit(""))))
