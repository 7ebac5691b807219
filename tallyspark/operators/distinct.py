"""Mergeable exact distinct counts.

Distinct counts cannot be added up, and several of them in one query multiply
the rows.  A bitmap by group and bucket can: bit p of bucket b stands for the
integer id ``32768 (b - 1) + p``.  ``id_bitmaps`` builds them once, partially
aggregated (a hot id or group is one bit or a few buckets in every map task);
any coarser count is the bitwise OR of stored bitmaps, then a count of bits.
Bitmaps are dense when ids are: surrogate keys as they come, or numbers given
by ``windows.rank_rows`` to other keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bitmaps(df: DataFrame, group: Sequence[str], key: str, sets: dict[str, Column | None]) -> DataFrame:
    """(group..., bucket, one bitmap per entry of ``sets``): the integer ids whose row meets the entry's condition.

    NULL ids count nowhere; a NULL condition is not met.
    """
    rows = df.filter(F.col(key).isNotNull()).withColumn("bucket", F.bitmap_bucket_number(F.col(key)))
    place = F.bitmap_bit_position(F.col(key))
    return rows.groupBy(*group, "bucket").agg(*[
        F.bitmap_construct_agg(place if cond is None else F.when(cond, place)).alias(name) for name, cond in sets.items()])


def merged(bitmaps: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Bitmaps of coarser groups: the OR of their buckets."""
    return bitmaps.groupBy(*group, "bucket").agg(*[F.bitmap_or_agg(F.col(n)).alias(n) for n in names])


def distinct_counts(bitmaps: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(group..., one count per name): distinct ids of each group, whatever finer groups the bitmaps have."""
    per = merged(bitmaps, group, names)
    return per.groupBy(*group).agg(*[F.coalesce(F.sum(F.bitmap_count(F.col(n))), F.lit(0)).cast("bigint").alias(n) for n in names])
