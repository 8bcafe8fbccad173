"""Gap-free numbering for any partitioning and any base."""

import pytest
from pyspark.sql import functions as F

from packetlake.operators.numbering import assign_index, number_by_key, range_marks, range_of, ranges_per_partition


@pytest.mark.parametrize("in_parts,out_parts", [(1, 1), (7, 3), (16, 8), (3, 20)])
def test_gap_free(spark, in_parts, out_parts):
    n = 5000
    df = (spark.range(n).select((F.col("id") * 7919 % 100003).alias("recv_seq"))
          .repartition(in_parts))
    out = assign_index(df, "recv_seq", base=42, num_partitions=out_parts).collect()
    pairs = sorted((r["recv_seq"], r["index"]) for r in out)
    assert [p[1] for p in pairs] == list(range(42, 42 + n))


def test_multi_key_order(spark):
    df = spark.createDataFrame([(2, 1), (1, 9), (1, 3), (2, 0)], "a int, b int")
    out = assign_index(df, ["a", "b"]).orderBy("index").collect()
    assert [(r["a"], r["b"], r["index"]) for r in out] == [(1, 3, 0), (1, 9, 1), (2, 0, 2), (2, 1, 3)]


def test_plan_has_no_global_window(spark):
    df = spark.range(100).withColumnRenamed("id", "recv_seq")
    plan = assign_index(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


from hypothesis import given, settings, strategies as st


@settings(max_examples=6, deadline=None)
@given(n=st.integers(min_value=0, max_value=3000), in_parts=st.integers(min_value=1, max_value=9),
       out_parts=st.one_of(st.none(), st.integers(min_value=1, max_value=12)),
       base=st.integers(min_value=0, max_value=10**12))
def test_gap_free_property(spark, n, in_parts, out_parts, base):
    df = spark.range(n).select((F.col("id") * 7919 % 1000003 - 500000).alias("recv_seq")).repartition(in_parts)
    out = assign_index(df, "recv_seq", base=base, num_partitions=out_parts).collect()
    pairs = sorted((r["recv_seq"], r["index"]) for r in out)
    assert [p[1] for p in pairs] == list(range(base, base + n))


@settings(max_examples=8, deadline=None)
@given(keys=st.lists(st.one_of(st.integers(-2**63, 2**63 - 1), st.integers(0, 50)), unique=True, max_size=60),
       parts=st.integers(1, 5), rows=st.integers(1, 20), base=st.integers(0, 10**12), null=st.booleans())
def test_by_key_equals_sorting(spark, keys, parts, rows, base, null):
    given_keys = keys + [None] * null
    df = spark.createDataFrame([(k, f"p{k}") for k in given_keys], "recv_seq bigint, payload string").repartition(parts)
    out = number_by_key(df, base=base, rows_per_range=rows).orderBy("index").collect()
    expected = [None] * null + sorted(keys)
    assert [(r["recv_seq"], r["payload"], r["index"]) for r in out] == [(k, f"p{k}", base + i) for i, k in enumerate(expected)]


def test_by_key_with_crowded_keys(spark):
    """A third of the keys lie side by side, the rest are spread over 2**50: ranges stay even and each is a partition."""
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") * 2**35 + 2**50).alias("recv_seq"))
    out = number_by_key(df, rows_per_range=1000).withColumn("part", F.spark_partition_id())
    parts = (out.groupBy("part").agg(F.count("*").alias("n"), F.min("index").alias("lo"), F.max("index").alias("hi"),
                                     F.min("recv_seq").alias("first"), F.max("recv_seq").alias("last")).orderBy("part").collect())
    assert len(parts) == 30 and max(p["n"] for p in parts) < 1500
    at = 0
    for p in parts:
        assert (p["lo"], p["hi"]) == (at, at + p["n"] - 1)
        at += p["n"]
    assert at == n and all(a["last"] < b["first"] for a, b in zip(parts, parts[1:]))


def test_marks_of_two_levels(spark):
    keys = spark.range(20_000).select((F.col("id") * F.col("id")).alias("k"))
    marks = range_marks(keys, rows_per_range=200, grid=8)
    counts = [r["n"] for r in keys.groupBy(range_of(F.col("k"), marks).alias("r")).agg(F.count("*").alias("n")).collect()]
    assert 90 <= len(marks) <= 110 and sum(counts) == 20_000 and max(counts) < 400


def test_by_key_shuffles_rows_once_and_checkpoints_nothing(spark):
    df = spark.range(5000).select(F.col("id").alias("recv_seq"), F.lit("x").alias("payload"))
    plan = number_by_key(df, rows_per_range=500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ExistingRDD" not in plan and "Join" not in plan


def test_many_small_ranges_share_partitions(spark):
    n = 6000
    df = spark.range(n).select(((F.col("id") * 7) % n).alias("recv_seq"))
    out = number_by_key(df, rows_per_range=3)
    assert out.rdd.getNumPartitions() <= 1024
    assert out.where("recv_seq = index").count() == n
    assert [ranges_per_partition(*x) for x in ((1, 0), (1024, 10**9), (1025, 10**5), (65_536, 36_000_000), (65_536, 10**12))] == [1, 1, 2, 64, 1]
