"""Connected components by alternating large and small stars, as joins and map-side minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(row["n"]), int(row["h"])


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each u; written, so that a join with a hot u can be split."""
    return common.durable(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, is joined to the smallest of them."""
    low = _lowest(edges)
    rest = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the component's smallest node.

    ``links`` has two columns of one orderable type; self links are dropped.
    Each round halves the distances at least, and is written to the shared
    folder; the driver sees a count and a checksum.
    """
    a, b = links.columns
    edges = common.durable(links.where(F.col(a) != F.col(b))
                           .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _checksum(edges)
    while before[0]:
        edges = common.durable(_small_star(common.durable(_large_star(edges))))
        now = _checksum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
