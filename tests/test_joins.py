"""The size-checked join: broadcast below the limit, salted shuffle above it."""

import pytest
from pyspark.sql import functions as F

from packetlake.operators.joins import bounded_broadcast_join, hot_keys, salted


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_same_rows_either_way(spark, limit, how):
    # A third of the big side on one hot key.
    big = spark.range(3000).select(F.col("id").alias("row"),
                                   F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(0, 40).select(F.col("id").alias("key"), F.concat(F.lit("v"), F.col("id")).alias("val"))
    out = bounded_broadcast_join(big, small, "k", "key", width=F.length("val"), salt=F.xxhash64("row"),
                                 how=how, limit_bytes=limit, salts=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastExchange" in plan) == (limit > 0)
    assert "_salt" not in out.columns
    got = sorted(tuple(r) for r in out.collect())
    want = sorted(tuple(r) for r in big.join(small, big.k == small.key, how).collect())
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_only_hot_keys_are_copied(spark, how):
    """Key 7 has more than 1,000 rows: four more copies of its row, none of the 39 others. Rows without a key are kept by a left join."""
    big = spark.range(3000).select(F.col("id").alias("row"),
                                   F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 15 > 1, F.col("id") % 50).alias("k"))
    small = spark.range(0, 40).select(F.col("id").alias("key"), F.concat(F.lit("v"), F.col("id")).alias("val"))
    assert [tuple(r) for r in hot_keys(big, "k", 250).collect()] == [(7, 5)]
    left, right = salted(big, small, "k", "key", F.xxhash64("row"), rows_per_copy=250)
    assert left.count() == 3000 and sorted(r.key for r in right.collect()) == sorted([*range(40), 7, 7, 7, 7])
    assert left.where("k IS NULL").select("_salt").distinct().count() > 100
    out = bounded_broadcast_join(big, small, "k", "key", width=F.length("val"), salt=F.xxhash64("row"),
                                 how=how, limit_bytes=0, rows_per_copy=250)
    expected = big.join(small, big.k == small.key, how)
    assert out.columns == expected.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
