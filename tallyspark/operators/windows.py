"""Window operators.

Windows over small, already-aggregated inputs (years per product) use plain
``Window``.  Ranking every row of a raw table uses ``rank_rows``: a range
partitioning on (group, order) splits even a group that holds a third of all
rows across many tasks, and each row's rank is its position inside its range
partition plus the number of rows of the same group in earlier partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize


def lag_growth(df: DataFrame, part: str, order: str, value: str, prev: str, rate: str,
               digits: int = 2) -> DataFrame:
    """Previous value by ``order`` within ``part`` and growth % = 100 * (cur - prev) / prev."""
    w = Window.partitionBy(part).orderBy(order)
    out = df.withColumn(prev, F.lag(value, 1).over(w))
    return out.withColumn(
        rate, F.round(F.try_divide(F.lit(100.0) * (F.col(value) - F.col(prev)), F.col(prev)), digits)
    )


def rank_rows(df: DataFrame, group: str, order: Sequence[Column], rn: str = "rn",
              num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` for every row, skew-safe.

    Steps:
      1. ``repartitionByRange(group, order...)`` + ``sortWithinPartitions``: the
         range bounds are sampled over the full sort key, so a hot group is
         split over many partitions;
      2. ``monotonically_increasing_id`` numbers the sorted rows of a
         partition consecutively; the numbered rows are stored in shared
         scratch, so ids and counts come from one physical result (a second
         range partitioning would sample bounds of its own);
      3. per (partition id, group): the first id and the row count; a running
         sum of counts over partition ids gives each piece's offset.  That
         window holds one row per partition a group spans, never its rows.
    rank = id - first id of the piece + 1 + offset.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(group).asc_nulls_first()] + list(order)
    numbered = (
        df.repartitionByRange(n, *sort_cols)
        .sortWithinPartitions(*sort_cols)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__pid", F.spark_partition_id())
    )
    numbered = materialize(numbered, "ranked")
    pieces = numbered.groupBy("__pid", F.col(group).alias("__g")).agg(
        F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    off_w = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__off", F.coalesce(F.sum("__n").over(off_w), F.lit(0)))
    cond = (numbered["__pid"] == pieces["__pid"]) & numbered[group].eqNullSafe(pieces["__g"])
    out = numbered.join(pieces, cond, "inner")
    ranked = out.withColumn(rn, (F.col("__mid") - F.col("__first") + 1 + F.col("__off")).cast("int"))
    return ranked.select(*[numbered[c] for c in df.columns], F.col(rn))
