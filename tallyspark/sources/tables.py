"""Table scans.

``spark.read.parquet`` is lazy: Catalyst prunes the columns a plan never uses
and pushes filters into the scan (``PushedFilters`` / ``ReadSchema`` in
``explain``), so adapters can expose wide rows at no cost.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str, prefix: str = "") -> DataFrame:
    """Full scan ``scan(table)`` of one parquet table (``<dir>/<prefix><name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{prefix}{name}.parquet"))


class tables:
    """Lazy accessor: ``t = tables(spark, sf_dir); t.orders``.

    Scans and the memoised adapters built on them are shared within one
    accessor only; a new accessor lists the files afresh, so a table that was
    replaced in between is read as it is now.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, prefix: str = ""):
        self.spark = spark
        self.sf_dir = sf_dir
        self.prefix = prefix
        self._cache: dict = {}

    def memo(self, key, build):
        """Build a derived DataFrame once per accessor (one lazy plan reused by every stage)."""
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = load(self.spark, self.sf_dir, name, self.prefix)
        return self._cache[name]


def scan_snapshot(df: DataFrame, partition_col: str, value) -> DataFrame:
    """Snapshot-partition scan: a filter on the partition column.

    On a ``partitionBy(partition_col)`` layout Spark turns this into partition
    pruning (``PartitionFilters`` in the scan), so only one snapshot is read.
    """
    return df.filter(F.col(partition_col) == F.lit(value))


def write_snapshots(df: DataFrame, path: str, snapshot: str, spread: int = 8) -> None:
    """A snapshot store: one folder per value of ``snapshot``.

    Each snapshot's rows are dealt over ``spread`` tasks (and files), so a large snapshot is not one task.
    """
    dealt = df.repartition(snapshot, F.pmod(F.xxhash64(*[c for c in df.columns if c != snapshot]), F.lit(spread)))
    dealt.write.mode("overwrite").partitionBy(snapshot).parquet(path)


def snapshot_of(store: DataFrame, snapshot: str, params: DataFrame) -> DataFrame:
    """The snapshots that a parameter table names in its column ``snapshot``.

    The parameter's value is known only when the query runs: the join's small
    side becomes a dynamic pruning filter on the store's folders, so the other
    snapshots are not read.  ``params`` should be filtered to the rows wanted.
    """
    return store.join(params.select(snapshot).distinct(), snapshot)
