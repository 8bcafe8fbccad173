"""Histogram selection and the offset built on it."""


import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetlake.operators.query import offset
from packetlake.operators.selection import Ties, nth_smallest


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-2**62, max_value=2**62), min_size=1, max_size=300, unique=True),
       st.integers(min_value=0, max_value=320), st.sampled_from([2, 7, 1024]))
def test_nth_smallest(spark, values, n, buckets):
    df = spark.createDataFrame([(v,) for v in values], "k bigint")
    want = sorted(values)[n] if n < len(values) else None
    assert nth_smallest(df, "k", n, buckets=buckets) == want


def test_skewed_keys(spark):
    # A third of the keys crowd into a tiny range; the rest spread wide.
    vals = list(range(1000)) + [10**15 + i * 7919 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "k bigint")
    for n in (0, 999, 1000, 2999):
        assert nth_smallest(df, "k", n, buckets=16) == sorted(vals)[n]


def test_ties_fall_back_to_numbering(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "k bigint, v string")
    with pytest.raises(Ties):
        nth_smallest(df, "k", 2)
    out = offset(df, 2, "k").collect()
    assert len(out) == 2 and out[-1]["k"] == 3


def test_offset_paths(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("index"), F.col("id").cast("string").alias("s"))
    assert [r["index"] for r in offset(df, 97, "index").collect()] == [291, 294, 297]
    assert offset(df, 100, "index").count() == 0
    assert offset(df, 0, "index").count() == 100
    assert [r["s"] for r in offset(df, 98, "s").collect()] == ["98", "99"]


def test_full_range_and_nulls(spark):
    ends = [-2**63, -5, 0, 7, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in ends], "k bigint")
    assert [nth_smallest(df, "k", n, buckets=3) for n in range(5)] == ends
    mixed = spark.createDataFrame([(None,), (None,), (3,), (1,)], "k bigint")
    for n in range(5):
        assert [r["k"] for r in offset(mixed, n, "k").collect()] == [None, None, 1, 3][n:]
