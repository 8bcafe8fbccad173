"""Keeping every core busy when an input arrives in too few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give per-row work at least one partition per core.

    Input splits normally outnumber the cores many times over and nothing
    happens.  A small input – one file of one row group, one micro-batch – is
    hashed on ``key``: deterministic, so a re-run task sees the same rows.
    ``df`` reads files and nothing else: its splits are known from their
    listing, whereas counting those of a plan with a shuffle would run it.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= parallelism:
        return df
    return df.repartition(parallelism, F.col(key))
