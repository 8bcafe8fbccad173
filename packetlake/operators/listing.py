"""the packet list and the packet detail as whole-table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render as R


def packet_listing(packets: DataFrame, zone: str = "UTC") -> DataFrame:
    """Time, Process, Source, Destination, Protocol, Size – one row per packet."""
    return packets.select(
        "index",
        R.format_time("timestamp", zone=zone).alias("time"),
        R.process_label("pname", "pid").alias("process"),
        R.endpoint_label("src_ip", "src_port").alias("source"),
        R.endpoint_label("dst_ip", "dst_port").alias("destination"),
        R.protocol_name("type").alias("protocol"),
        R.format_size("length").alias("size"),
    )


def packet_detail(packets: DataFrame, zone: str = "UTC") -> DataFrame:
    """The detail view of packets (with payload): run it on a lookup's result."""
    return packets.select(
        "index",
        R.format_time("timestamp", include_date=True, zone=zone).alias("time"),
        R.text_or_missing("uuid").alias("uuid"),
        R.protocol_name("type").alias("protocol"),
        R.format_size("length").alias("size"),
        R.endpoint_label("src_ip", "src_port").alias("source"),
        R.endpoint_label("dst_ip", "dst_port").alias("destination"),
        R.text_or_missing("pname").alias("process_name"),
        F.coalesce(F.col("pid").cast("string"), F.lit(R.MISSING)).alias("pid"),
        R.payload_render("is_binary", "payload_utf8", "payload_binary").alias("payload"),
        F.when(R.packet_valid(), F.lit(True)).otherwise(F.lit(False)).alias("valid"),
    )
