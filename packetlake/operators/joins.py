"""Joins against a side whose size is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A small side is broadcast only when measured below this many bytes.
BROADCAST_LIMIT_BYTES = 64 << 20
# Big rows of one key that share a copy of the small side's row, when that is too big to broadcast.
ROWS_PER_COPY = 65_536
HOT = ["_hot_key", "_copies"]


def measure(df: DataFrame, width: Column) -> tuple[int, int]:
    """(rows, approximate bytes) of ``df``; ``width`` is a per-row byte count.

    One aggregate job; the per-row width expression reads only the columns the
    join keeps, so the scan is pruned to them.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def fits(n: int, nbytes: int, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether a side measured at so many rows and bytes is broadcast."""
    return nbytes + 32 * n <= limit_bytes


def bounded_broadcast_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str,
                           width: Column, salt: Column, how: str = "inner",
                           limit_bytes: int = BROADCAST_LIMIT_BYTES,
                           salts: int | None = None,
                           measured: tuple[int, int] | None = None,
                           rows_per_copy: int = ROWS_PER_COPY) -> DataFrame:
    """Equi-join ``big`` to ``small``, broadcasting ``small`` only if it is small.

    ``width`` estimates the bytes of one ``small`` row; the measured total
    (plus 32 bytes of row overhead) decides.  Beyond the limit the join is a
    shuffle join of both sides as they are.  Only a key with more than
    ``rows_per_copy`` rows in ``big`` is split: its ``small`` rows are copied once per
    so many (``salts`` times at most, if given) and each ``big`` row picks one copy by
    ``salt`` – a *deterministic* expression of the big row (a hash of its own columns),
    so a re-run map task sends every row to the same reducer.  The copies of
    all keys are thus fewer than rows of ``big`` / ``rows_per_copy``.  Rows of ``big``
    without a key match nothing and are dealt by ``salt`` alone.  ``measured`` passes a
    measurement the caller already holds for unchanged input.
    """
    n, nbytes = measured if measured is not None else measure(small, width)
    if fits(n, nbytes, limit_bytes):
        return big.join(F.broadcast(small), big[big_key] == small[small_key], how)
    salted_big, salted_small = salted(big, small, big_key, small_key, salt, rows_per_copy, salts)
    # Measured too big: keep Spark from broadcasting it on an optimistic
    # estimate; sort-merge spills where a hash table would not.
    salted_small = salted_small.hint("merge")
    cond = (salted_big[big_key] == salted_small[small_key]) & (salted_big["_salt"] == salted_small["_salt"])
    return salted_big.join(salted_small, cond, how).drop(salted_big["_salt"]).drop(salted_small["_salt"])


def salted(big: DataFrame, small: DataFrame, big_key: str, small_key: str, salt: Column,
           rows_per_copy: int = ROWS_PER_COPY, salts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: 0 but for the hot keys, whose rows in ``small`` are copied, and for rows of ``big`` without a key."""
    unkeyed = F.when(F.col(big_key).isNull(), salt)
    hot = hot_keys(big, big_key, rows_per_copy, salts).collect()
    if not hot:
        return big.withColumn("_salt", unkeyed.otherwise(0)), small.withColumn("_salt", F.lit(0).cast("bigint"))
    schema = T.StructType([T.StructField(HOT[0], big.schema[big_key].dataType), T.StructField(HOT[1], T.LongType())])
    hot = F.broadcast(big.sparkSession.createDataFrame(hot, schema))
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    with_big = big.join(hot, F.col(big_key) == F.col("_hot_key"), "left").withColumn(
        "_salt", unkeyed.otherwise(F.pmod(salt, copies)))
    with_small = small.join(hot, F.col(small_key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    return with_big.drop(*HOT), with_small.drop(*HOT)


def hot_keys(big: DataFrame, key: str, rows_per_copy: int = ROWS_PER_COPY, most: int | None = None) -> DataFrame:
    """(_hot_key, _copies) of the keys with more than ``rows_per_copy`` rows: fewer than rows / ``rows_per_copy``."""
    rows = (big.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot_key"))
            .agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_copy))
    copies = F.ceil(F.col("_rows") / rows_per_copy)
    return rows.select("_hot_key", (copies if most is None else F.least(copies, F.lit(most))).cast("bigint").alias("_copies"))
