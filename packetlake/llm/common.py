"""Helpers shared by the corpus operators: tables, checkpoints, Arrow columns and ranks without a global task."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package


ROWS_PER_BUCKET = 50_000    # rows that one task ranks or sums in order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the package goes to the Python workers with it."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    return [v if v is not None else b"" for v in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null is the empty text."""
    return [v if v is not None else "" for v in column.to_pylist()]


def map_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` where ``work(batch)`` gives one record batch (or None) per record batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // rows_per_bucket))


def running_total(df: DataFrame, group: list[str], order: list[str], value, bucket: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of ``group`` that precede a row in (``bucket``, ``order``).

    ``bucket`` is a column that cuts each group into pieces of bounded size, in
    order; a hot group is thus summed by many tasks.  Only one row per (group,
    bucket) meets in the window over buckets.  ``df`` must be repeatable
    (checkpointed), as it is read twice.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = c if same is None else same & c
    joined = local.join(starts, same, "inner")
    return (joined.withColumn(out, F.col("_start") + F.col("_local"))
            .drop("_start", "_local", *[f"_k{i}" for i in range(len(keys))]))
