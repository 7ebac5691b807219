"""Pivots and transposes.

* ``conditional_max_pivot``: fixed value list -> ``max(CASE WHEN type = v THEN attr END)``
  columns in one aggregate (the shape of ``groupBy().pivot(values).agg(max)``).
* ``positional_crosstab``: one-argument ``crosstab`` semantics -- per row key,
  values fill slots 1..n by sorted position (not by category); extras are
  dropped and missing slots are NULL.  The ``row_number() <= n`` filter is
  planned by Catalyst as a ``WindowGroupLimit`` that keeps only n rows per key
  in every map task, so a hot key does not ship all its rows.
* ``composition_signature``: the sorted distinct items of a group joined by a
  separator, limited to the first ``max_items``.
* ``record_transpose``: chosen columns become rows, a key's first n records
  become columns r1..rn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def conditional_max_pivot(df: DataFrame, keys: Sequence[str], type_col: str, types: dict,
                          attrs: dict[str, str]) -> DataFrame:
    """Per key, one column per (type, attribute): the max attribute among rows of that type."""
    aggs = [
        F.max(F.when(F.col(type_col) == F.lit(v), F.col(a))).alias(f"{prefix}_{suffix}")
        for v, prefix in types.items()
        for a, suffix in attrs.items()
    ]
    return df.groupBy(*keys).agg(*aggs)


def rank_top_n(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str], n: int,
               rn: str = "rn") -> DataFrame:
    """Rows ranked 1..n within each key by ``order`` (a total order)."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)


def positional_crosstab(df: DataFrame, key: str, value: str, n: int, order: Sequence[Column | str] | None = None,
                        prefix: str | None = None) -> DataFrame:
    """``crosstab(sql)`` one-argument form with an explicit order (default: ``value`` ascending)."""
    order = list(order) if order is not None else [F.col(value).asc()]
    ranked = rank_top_n(df, key, order, n, "__rn")
    prefix = prefix or value
    return ranked.groupBy(key).agg(
        *[F.max(F.when(F.col("__rn") == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, n + 1)]
    )


def composition_signature(df: DataFrame, keys: Sequence[str], item: Column | str, max_items: int | None = None,
                          sep: str = "&", out: str = "signature") -> DataFrame:
    """Sorted distinct items per group joined by ``sep``: all of them, or the first ``max_items``.

    ``<out>_size`` is the number of distinct items, whatever ``max_items`` is.
    """
    it = F.col(item) if isinstance(item, str) else item
    distinct_items = df.select(*keys, it.alias("__item")).filter(F.col("__item").isNotNull()).distinct()
    items = F.array_sort(F.collect_list("__item"))
    if max_items is not None:
        items = F.slice(items, 1, max_items)
    return distinct_items.groupBy(*keys).agg(
        F.array_join(items, sep).alias(out), F.count(F.lit(1)).alias(f"{out}_size"))


def record_transpose(df: DataFrame, key: str, order: Sequence[Column | str], columns: Sequence[str], n: int,
                     col_name: str = "col", prefix: str = "r") -> DataFrame:
    """Per key: one output row per chosen column, the key's first n records as r1..rn (text).

    Values are cast to text with Spark's cast; format doubles first (e.g. as a
    decimal) when a fixed text form matters.
    """
    ranked = rank_top_n(df, key, order, n, "__rn")
    stacked = ranked.select(
        key, "__rn",
        F.explode(F.array(*[F.struct(F.lit(c).alias(col_name), F.col(c).cast("string").alias("__val"))
                            for c in columns])).alias("__kv"),
    ).select(key, "__rn", F.col(f"__kv.{col_name}").alias(col_name), F.col("__kv.__val").alias("__val"))
    return stacked.groupBy(key, col_name).agg(
        *[F.max(F.when(F.col("__rn") == i, F.col("__val"))).alias(f"{prefix}{i}") for i in range(1, n + 1)]
    )


def pivot_top_n(df: DataFrame, key: str, order: Sequence[Column | str], values: Sequence[str], n: int,
                extra: Sequence[str] = ()) -> DataFrame:
    """Two-argument ``crosstab`` on a rank: slots 1..n of each value column, plus the first
    record's ``extra`` columns."""
    ranked = rank_top_n(df, key, order, n, "__rn")
    aggs = [F.max(F.when(F.col("__rn") == 1, F.col(e))).alias(e) for e in extra]
    for i in range(1, n + 1):
        for v in values:
            aggs.append(F.max(F.when(F.col("__rn") == i, F.col(v))).alias(f"{v}_{i}"))
    return ranked.groupBy(key).agg(*aggs)
