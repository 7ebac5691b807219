"""History tables: current version of an SCD2 table (J3) and latest row per key.

``latest_row`` uses ``max(struct(order...))`` grouped by the key instead of a
``row_number`` window: it is a partially aggregated (map-side
combined) reduction, so a key holding a third of all rows is reduced in every
map task before the shuffle and never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import drop_scratch, store

OPEN_END = "5999-12-31 00:00:00"


def current_version(df: DataFrame, valid_to: str = "effective_to", deleted: str | None = "deleted_flg",
                    open_end: str = OPEN_END) -> DataFrame:
    """Rows whose validity has not ended and that are not deleted."""
    cond = F.col(valid_to) == F.lit(open_end).cast("timestamp")
    if deleted:
        cond = cond & (F.col(deleted) == F.lit("0"))
    return df.filter(cond)


def latest_row(df: DataFrame, key: str | Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Latest row per key: ``QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY order_cols DESC) = 1``.

    Returns the key and ``order_cols``; list every column to keep in
    ``order_cols`` (later ones break ties), so the result is deterministic.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in order_cols if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in rest])).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def build_history(changes: DataFrame, key: str, at: Sequence[str], values: Sequence[str],
                  num_partitions: int | None = None) -> DataFrame:
    """Change rows -> non-overlapping validity intervals (the history that ``current_version`` reads).

    ``at``: the change time (a timestamp), then columns that order changes of one time.
    Result: key, values, ``effective_from``, ``effective_to`` (the next change, or
    the open end), ``deleted_flg``.  Of several changes at one time the last
    counts; equal neighbours are one interval.

    Rows are range-partitioned by (key, time), so a key with a third of all
    rows is dealt over many tasks.  Inside a partition neighbours meet in a
    window by (partition, key); the rows at a piece's edges meet those of the
    key's next piece through a table with one row per piece.
    """
    spark = changes.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = F.struct(*[F.col(c).alias(c) for c in values]).alias("state")
    # one change per key and time: partial, before anything is sorted
    last = changes.groupBy(F.col(key).alias("k"), F.col(at[0]).alias("t")).agg(
        F.max(F.struct(*[F.col(c) for c in at[1:]], state)).getField("state").alias("state"))
    order = [F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first()]
    ranged, path = store(last.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("piece", F.spark_partition_id()), "changes")
    kept, kept_path = _with_previous(ranged, "state", F.max_by(F.struct("state"), F.col("t")).getField("state"))
    drop_scratch(spark, path)
    starts = kept.filter(~F.col("prev_known") | ~F.col("state").eqNullSafe(F.col("prev"))).select("piece", "k", "t", "state")
    starts, path = store(starts, "starts")
    inside = Window.partitionBy("piece", "k").orderBy("t")
    pieces = starts.groupBy("piece", "k").agg(F.min("t").alias("first"))
    after = Window.partitionBy("k").orderBy("piece")  # one row per piece of a key
    later = pieces.withColumn("later", F.lead("first").over(after)).select("piece", "k", "later")
    joined = starts.withColumn("next", F.lead("t").over(inside)).alias("a").join(
        later.alias("b"), (F.col("a.piece") == F.col("b.piece")) & F.col("a.k").eqNullSafe(F.col("b.k")))
    ends = F.coalesce("a.next", "b.later", F.lit(OPEN_END).cast(changes.schema[at[0]].dataType))
    out, _ = store(joined.select(F.col("a.k").alias(key), *[F.col(f"a.state.{c}").alias(c) for c in values],
                                 F.col("a.t").alias("effective_from"), ends.alias("effective_to"),
                                 F.lit("0").alias("deleted_flg")), "history")
    for p in (path, kept_path):
        drop_scratch(spark, p)
    return out


def _with_previous(ranged: DataFrame, column: str, last: Column) -> tuple[DataFrame, str]:
    """``ranged`` (piece, k, t, ...) with ``prev``, the column's value in the key's row before, and ``prev_known``; stored."""
    inside = Window.partitionBy("piece", "k").orderBy("t")
    rows = ranged.withColumns({"own": F.lag(F.struct(column)).over(inside), "nth": F.row_number().over(inside)})
    pieces = ranged.groupBy("piece", "k").agg(last.alias("ends"))
    before = Window.partitionBy("k").orderBy("piece")  # one row per piece of a key
    edges = pieces.withColumn("edge", F.lag(F.struct("ends")).over(before)).select("piece", "k", "edge")
    joined = rows.alias("a").join(edges.alias("b"), (F.col("a.piece") == F.col("b.piece")) & F.col("a.k").eqNullSafe(F.col("b.k")))
    first = F.col("a.nth") == 1
    prev = F.when(first, F.col("b.edge").getField("ends")).otherwise(F.col("a.own").getField(column))
    known = F.when(first, F.col("b.edge").isNotNull()).otherwise(F.lit(True))
    return store(joined.select("a.piece", "a.k", "a.t", f"a.{column}", prev.alias("prev"), known.alias("prev_known")), "neighbours")
