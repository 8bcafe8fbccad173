"""The n-th smallest value of an integral column, without sorting or copying rows.

The first scan takes a KLL sketch of the column: quantiles at ``GRID`` evenly
spaced ranks, with a small rank error.  The two around rank ``n`` bracket the value.  If
the bracket holds few values, a second scan counts the rows below it and the rows of each
value in it, which gives the answer; else that scan counts and sketches the bracket,
and so on.  A column of some ten million rows takes two scans, and each further scan a column
of some hundred times as many.  Ranges reach the scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
GRID = 1_024
SKETCH_K = 4_096          # accuracy of the sketch: ranks are off by about 0.1 per cent at most
SLACK = 3                 # grid steps that a rank may be off
GATHERED = 65_536         # values of a bracket that may be counted one by one


class Ties(Exception):
    """Several rows share the value at rank ``n``: a value cannot split them."""


def _marks(values: Column, grid: int) -> Column:
    """The least value, the quantiles at ``grid - 1`` ranks and the largest value."""
    ranks = F.array(*[F.lit(i / grid) for i in range(1, grid)])
    inner = F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint(values, SKETCH_K), ranks)
    return F.when(F.count(values) > 0, F.concat(F.array(F.min(values)), inner, F.array(F.max(values))))


def nth_smallest(df: DataFrame, col: str, n: int, buckets: int = GRID, gathered: int = GATHERED) -> int | None:
    """Value at 0-based rank ``n`` in ascending order of non-null ``col``; None if there are
    ``n`` rows or fewer.  Raises ``Ties`` when the value is shared.  ``buckets`` is the grid of ranks."""
    if not isinstance(df.schema[col].dataType, INTEGRAL):
        raise TypeError(f"{col} is not an integral column")
    grid = max(2, buckets)
    keys = df.select(F.col(col).cast("long").alias("k")).filter(F.col("k").isNotNull())
    k = F.col("k")
    first = keys.agg(F.count(F.lit(1)).alias("n"), _marks(k, grid).alias("marks")).first()
    below, count, marks = 0, int(first["n"]), first["marks"]      # rows under the range, rows in it
    if count <= n:
        return None
    while True:
        lo, hi = marks[0], marks[-1]
        if lo == hi:
            break
        at = (n - below) * grid // count
        left, right = marks[max(0, at - SLACK)], marks[min(grid, at + 1 + SLACK)]
        if (left, right) == (lo, hi) and count > gathered:
            right = lo + (hi - lo) // 2                            # no closer bracket: halve the range
        inside = keys.filter((k >= lo) & (k <= hi))
        if count * (2 * SLACK + 2) // grid <= gathered or count <= gathered:
            found = None
            rows = (inside.filter(k <= right).groupBy(F.when(k >= left, k).alias("k"))
                    .agg(F.count(F.lit(1)).alias("c")).collect())
            under = below + sum(r["c"] for r in rows if r["k"] is None)
            for r in sorted((r for r in rows if r["k"] is not None), key=lambda r: r["k"]):
                if under <= n < under + r["c"]:
                    found = r
                    break
                under += r["c"]
            if found is not None:
                lo, count = found["k"], found["c"]
                break
            # The sketch was off: count the three parts of the range.
        within = F.when((k >= left) & (k <= right), k)
        s = inside.agg(F.count(F.when(k < left, 1)).alias("lower"), F.count(within).alias("n"), _marks(within, grid).alias("marks")).first()
        if below <= n - s["lower"] < below + s["n"]:
            below, count, marks = below + s["lower"], s["n"], s["marks"]
            continue
        if n < below + s["lower"]:
            part, below = inside.filter(k < left), below
        else:
            part, below = inside.filter(k > right), below + s["lower"] + s["n"]
        s = part.agg(F.count(F.lit(1)).alias("n"), _marks(k, grid).alias("marks")).first()
        count, marks = s["n"], s["marks"]
    if count > 1:
        raise Ties(f"{count} rows share {col} = {lo}")
    return lo
