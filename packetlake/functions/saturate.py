"""Saturating narrowing casts (wire int64 → table int32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32_MIN = -2147483648
INT32_MAX = 2147483647


def saturate_int32(c) -> Column:
    """Clamp a BIGINT into the int32 range, then cast: 2^31 → 2^31-1; null stays null.

    (``greatest``/``least`` skip nulls, so they would turn a null into a bound.)
    """
    col = F.col(c) if isinstance(c, str) else c
    return (F.when(col > F.lit(INT32_MAX), F.lit(INT32_MAX))
            .when(col < F.lit(INT32_MIN), F.lit(INT32_MIN))
            .otherwise(col).cast("int"))
