"""Measures (A1-A19): filtered aggregates, penetration shares, weighted averages.

Several metrics over the same input are compiled into ONE ``groupBy`` with
filtered aggregates instead of one subquery (and one scan) per metric; Catalyst
does not fuse differing aggregates over the same input by itself.  Every
aggregate here is algebraic (sum/count/min/max), so Spark combines it map-side
before the shuffle and a hot key never travels whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numeric import MONEY


@dataclass(frozen=True)
class Metric:
    """A penetration metric: share of rows (and of ``amount``) that satisfy ``predicate``.

    ``base`` restricts the denominator (and numerator) population, e.g. the
    metrics that exclude one product.
    """

    name: str
    predicate: Column
    base: Column | None = None


def count_where(pred: Column) -> Column:
    """Number of rows where ``pred`` is true (NULL counts as false)."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def penetration(df: DataFrame, key: str, metrics: Sequence[Metric], amount: str,
                digits: int = 6) -> DataFrame:
    """Per key: ``{m}_penet_sht`` = count share and ``{m}_penet_rub`` = amount share.

    Each metric has its own population (``base``); all metrics share one
    aggregate pass over ``df``.
    """
    amt = F.col(amount).cast(MONEY)
    aggs = []
    for m in metrics:
        base = m.base if m.base is not None else F.lit(True)
        hit = base & m.predicate
        aggs += [
            count_where(hit).alias(f"__{m.name}_cnt"),
            count_where(base).alias(f"__{m.name}_den"),
            F.sum(F.when(hit, amt).otherwise(F.lit(0).cast(MONEY))).alias(f"__{m.name}_sum"),
            F.sum(F.when(base, amt)).alias(f"__{m.name}_dsum"),
        ]
    g = df.groupBy(key).agg(*aggs)
    out = [F.col(key)]
    for m in metrics:
        out += [
            F.round(F.try_divide(F.col(f"__{m.name}_cnt").cast("double"),
                                 F.col(f"__{m.name}_den").cast("double")), digits).alias(f"{m.name}_penet_sht"),
            F.round(F.try_divide(F.col(f"__{m.name}_sum").cast("double"),
                                 F.col(f"__{m.name}_dsum").cast("double")), digits).alias(f"{m.name}_penet_rub"),
        ]
    return g.select(*out)


def weighted_average(value: Column, weight: Column) -> Column:
    """sum(value * weight) / sum(weight), NULL when the weight sum is 0 or NULL."""
    return F.try_divide(F.sum(value * weight).cast("double"), F.sum(weight).cast("double"))


def nullif_zero(col: Column) -> Column:
    """Emulates "absent group -> NULL" for counts computed in one pass."""
    return F.when(col != 0, col)


def null_when_key_null(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """A NULL key never matches an equi-join: blank the joined-in columns for it."""
    keep = [c for c in df.columns]
    return df.select(*[F.when(F.col(key).isNotNull(), F.col(c)).alias(c) if c in cols else F.col(c) for c in keep])


def constant_per_group(df: DataFrame, key: str, name: str, value) -> DataFrame:
    """One row per existing key with a constant measure."""
    return df.select(key).distinct().withColumn(name, F.lit(value))
