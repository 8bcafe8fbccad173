"""Summaries of the whole history that a feed's statement may use, kept up batch by batch.

A statement such as ``SELECT * FROM packets WHERE length > (SELECT mean FROM
totals)`` asks for an aggregate of everything stored so far.  A summary keeps
algebraic partials (count, sum, least, largest) per group: a batch's partials are aggregated
from its rows alone and merged with the state that the batch before left, so a
tick costs the same after ten batches and after a thousand.  The state of each batch is a
small table of its own, ``summaries/<feed>/<name>/batch_id=<id>``, overwritten by a replay with the
same rows.  The measures are exact merges: the result equals aggregating all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Summary:
    """``SELECT <keys>, <measures> FROM packets [WHERE where] GROUP BY <keys>`` under a name.

    ``measures``: alias -> (count | sum | avg | min | max, SQL expression over the
    packet columns).  Nulls are left out by each measure, as in SQL; without keys there is always one row.
    """

    measures: dict[str, tuple[str, str]]
    keys: tuple[str, ...] = field(default=())
    where: str | None = None

    def __post_init__(self):
        for alias, (kind, _) in self.measures.items():
            if kind not in KINDS:
                raise ValueError(f"measure {alias}: {kind} can't be merged; use one of {', '.join(KINDS)}")

    def _exact(self, rows: DataFrame, expression: str) -> Column:
        """An expression to be summed: whole numbers as decimals, so that no order of merging matters or overflows."""
        kind = rows.select(F.expr(expression).alias("x")).schema["x"].dataType
        whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return F.expr(expression).cast("decimal(38,0)") if whole else F.expr(expression)

    def partial(self, rows: DataFrame) -> DataFrame:
        """The partials of some rows: keys, then <alias>_n, _s, _lo or _hi."""
        aggs = []
        for alias, (kind, expression) in self.measures.items():
            if kind in ("count", "avg"):
                aggs.append(F.count(F.expr(expression)).alias(f"{alias}_n"))
            if kind in ("sum", "avg"):
                aggs.append(F.sum(self._exact(rows, expression)).alias(f"{alias}_s"))
            if kind == "min":
                aggs.append(F.min(F.expr(expression)).alias(f"{alias}_lo"))
            if kind == "max":
                aggs.append(F.max(F.expr(expression)).alias(f"{alias}_hi"))
        chosen = rows if self.where is None else rows.where(self.where)
        return chosen.groupBy(*self.keys).agg(*aggs)

    def merge(self, older: DataFrame, newer: DataFrame) -> DataFrame:
        """The delta rule: partials of both, added up group by group."""
        both = older.unionByName(newer)
        merged = {"_n": F.sum, "_s": F.sum, "_lo": F.min, "_hi": F.max}
        aggs = [next(f for end, f in merged.items() if c.endswith(end))(c).cast(both.schema[c].dataType).alias(c)
                for c in both.columns if c not in self.keys]
        return both.groupBy(*self.keys).agg(*aggs)

    def finish(self, partials: DataFrame) -> DataFrame:
        """The summary itself: keys and measures."""
        out = []
        for alias, (kind, _) in self.measures.items():
            if kind == "avg":
                out.append(F.when(F.col(f"{alias}_n") > 0, F.col(f"{alias}_s").cast("double") / F.col(f"{alias}_n")).alias(alias))
            else:
                out.append(F.col(alias + {"count": "_n", "sum": "_s", "min": "_lo", "max": "_hi"}[kind]).alias(alias))
        return partials.select(*self.keys, *out)

    def over(self, rows: DataFrame) -> DataFrame:
        """The summary of ``rows`` at once."""
        return self.finish(self.partial(rows))
