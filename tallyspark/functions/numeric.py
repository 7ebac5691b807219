"""Numeric helpers: exact money sums, guarded ratios, numeric truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(col: Column | str) -> Column:
    """Money as an exact decimal so that sums do not depend on row order."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """``ratio`` rounded to ``digits`` decimals."""
    return F.round(ratio(num, den), digits)


def trunc0(col: Column) -> Column:
    """Numeric ``TRUNC(x, 0)``: toward zero, for either sign."""
    return F.when(col >= 0, F.floor(col)).otherwise(F.ceil(col)).cast("bigint")
