"""Gap-free row numbers in arrival order, without one global task.

Plan: range-partition by the order key (Spark samples the key to pick the
bounds, so partitions are balanced even when keys cluster), cut the lineage
with a reliable ``checkpoint()`` so the partition of every row is fixed even
when a task is re-run on another executor, count rows per partition (one row
per partition), turn the counts into start offsets with a window over that
tiny table, broadcast it back (its size is the partition count), sort each
partition locally and add the row's position within its partition.

For one integral key (``recv_seq``) ``number_by_key`` needs no checkpoint: quantiles of a
KLL sketch cut the key into ranges, and a row's number is its range's start plus its place in
the range, both functions of the keys alone.  A re-run task finds the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

ROWS_PER_RANGE = 131_072
GRID = 1_024              # ranges cut by one sketch; more are cut by a sketch for each of these
MAX_RANGES = 65_536       # above MAX_RANGES * ROWS_PER_RANGE rows, ranges grow
SKETCH_K = 4_096
_POS_BITS = 33  # monotonically_increasing_id = (partition id << 33) + position


def assign_index(df: DataFrame, order_col: str | list[str] = "recv_seq", base: int = 0,
                 out: str = "index", num_partitions: int | None = None) -> DataFrame:
    """Number ``df`` base, base+1, … by ascending ``order_col`` (unique key).

    ``order_col`` may be a list: rows are then ordered by those columns in turn.
    ``num_partitions`` fixes the range partitions (1: one task, for inputs the
    caller counted to be small); by default AQE sizes them.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    keys = [order_col] if isinstance(order_col, str) else list(order_col)
    n = num_partitions
    if n == 1:
        # One partition holds every row whatever happens, so the numbering is
        # deterministic without sampling, checkpoint or counts.  The caller
        # picks n = 1 only for inputs it has counted to be small (and, in the
        # capture path, cached), so merging partitions needs no shuffle.
        one = (df.coalesce(1).sortWithinPartitions(*keys)
               .withColumn(out, F.lit(base) + F.monotonically_increasing_id()))
        return one
    # Without a count, AQE sizes the range partitions; it only merges adjacent
    # ranges, so partition order still follows the key.
    cols = [F.col(k) for k in keys]
    ranged = (df.repartitionByRange(n, *cols) if n else df.repartitionByRange(*cols))
    ranged = (ranged.withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a single-partition window over it is bounded.
    starts = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
         ).alias("_start"))
    starts = starts.select("_part", F.coalesce("_start", F.lit(0)).alias("_start"))
    numbered = (ranged.join(F.broadcast(starts), "_part")
                .sortWithinPartitions(*keys)
                .withColumn("_pos", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("bigint"), _POS_BITS)))
    return (numbered.withColumn(out, F.lit(base) + F.col("_start") + F.col("_pos"))
            .drop("_part", "_start", "_pos"))


def number_by_key(df: DataFrame, key: str = "recv_seq", base: int = 0, out: str = "index",
                  rows_per_range: int = ROWS_PER_RANGE, at_most: int | None = None) -> DataFrame:
    """Number ``df`` base, base+1, … by ascending ``key`` (integral, unique), with a row without a key first.

    Two scans of the key column alone find the ranges and count their rows; the
    rows themselves are shuffled once, each range to a partition of its own, in order, which is the
    layout the store keeps.  Of more than ``GRID`` small ranges, neighbours share a partition of at most
    about ``ROWS_PER_RANGE`` rows: tasks then grow with the rows, not with the ranges.  ``at_most``, an upper bound of the row count, saves both scans
    where one range holds all rows.  ``df`` must give the same rows each time it is read.
    """
    name = f"_{out}_range"
    keys = df.select(F.col(key).cast("bigint").alias("k"))
    marks = [] if at_most is not None and at_most <= rows_per_range else range_marks(keys, rows_per_range)
    starts = [0] * (len(marks) + 1)
    if marks:
        counts = {r["r"]: r["n"] for r in keys.groupBy(range_of(F.col("k"), marks).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for i in range(len(marks)):
            starts[i + 1] = starts[i] + counts.get(i, 0)
        shared = ranges_per_partition(len(starts), starts[-1] + counts.get(len(marks), 0))
        marks, starts = marks[shared - 1::shared], starts[::shared]
    ranged = (df.withColumn(name, range_of(F.col(key).cast("bigint"), marks))
              .repartitionById(len(starts), F.col(name)))
    place = F.row_number().over(Window.partitionBy(name).orderBy(F.col(key).asc_nulls_first()))
    return (ranged.withColumn(out, F.lit(base - 1).cast("bigint") + F.get(_numbers(starts), F.col(name)) + place)
            .drop(name))


def ranges_per_partition(ranges: int, rows: int) -> int:
    """How many neighbouring ranges share a partition: 1 up to ``GRID`` ranges."""
    return max(1, min(-(-ranges // GRID), ranges * ROWS_PER_RANGE // max(1, rows)))


def range_marks(keys: DataFrame, rows_per_range: int = ROWS_PER_RANGE, grid: int = GRID) -> list[int]:
    """Ascending keys that cut column ``k`` into ranges of about ``rows_per_range`` rows; at most ``MAX_RANGES`` - 1."""
    def quantiles(parts: int):
        ranks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        return F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint("k", SKETCH_K), ranks)

    keys = keys.where("k IS NOT NULL")
    n = keys.count()
    parts = min(MAX_RANGES, -(-n // rows_per_range))
    if parts <= 1:
        return []
    marks = sorted(set(keys.agg(quantiles(min(grid, parts)).alias("q")).first()["q"]))
    if (finer := -(-parts // grid)) > 1:
        within = keys.groupBy(range_of(F.col("k"), marks).alias("r")).agg(quantiles(finer).alias("q"))
        marks = sorted(set(marks).union(*(r["q"] for r in within.collect())))
    return marks


def range_of(key: Column, marks: list[int]) -> Column:
    """How many of the ascending ``marks`` are at most ``key``, by bisection; 0 for a null key."""
    if not marks:
        return F.lit(0)
    table = _numbers(marks)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(marks).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(marks)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))


def _numbers(values: list[int]) -> Column:
    """A constant array, folded from its text: one literal instead of an expression for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
