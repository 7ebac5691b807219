"""Joins of rows to a table with one row a key, when a few keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this part of the rows, so there are never more hot keys than this.
SHARE = 256
#: Rows of a hot key for each salt that it is dealt to.
DEALT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table`` (one short row a key), no task gathering a hot key's rows.

    ``counts`` has (key, count) of ``rows``, ``total`` their number.  At most
    ``SHARE`` keys can each hold more than a ``SHARE``-th of the rows: their
    table rows, at most that many, are broadcast; all other keys are shuffled.
    Rows with a null key are kept by a left join only.
    """
    heavy = [r[0] for r in counts.filter(F.col("count") > max(total // SHARE, 1)).filter(F.col(key).isNotNull())
             .select(key).collect()]  # at most SHARE keys
    if not heavy:
        return rows.join(table, key, how)
    hot = F.col(key).isin([F.lit(k) for k in heavy])
    cold = rows.filter(~hot | F.col(key).isNull()).join(table.filter(~hot), key, how)
    return cold.unionByName(rows.filter(hot).join(F.broadcast(table.filter(hot)), key, how))


def salted(rows: DataFrame, table: DataFrame, key: str, other: str, total: int, places: DataFrame | None = None,
           also: tuple = ()) -> DataFrame:
    """``rows`` with the columns of ``table`` (of any width), a hot key's rows dealt over many tasks.

    ``table`` has one row for a key and the columns ``also``, which ``rows`` has too.
    Only keys with more than a ``SHARE``-th of all rows (and more than ``DEALT``) are dealt, by their ``other`` column;
    their table rows are sent to every salt, at most 4096 times, those of all
    other keys once.  ``places`` has all pairs of ``key`` and ``other`` of the
    rows: the stored table that the rows were made from, so that they are not
    made twice.
    """
    salts = min(max(total // DEALT, 1), 4096)
    heavy = []
    if salts > 1:
        counts = (rows if places is None else places).groupBy(key).count()
        heavy = [r[0] for r in counts.filter(F.col("count") > max(total // SHARE, DEALT)).filter(F.col(key).isNotNull())
                 .select(key).collect()]  # at most SHARE keys
    if not heavy:
        return rows.join(table, [key, *also])
    hot = F.col(key).isin([F.lit(k) for k in heavy])
    salt = F.when(hot, F.pmod(F.xxhash64(other), F.lit(salts))).otherwise(F.lit(0).cast("long")).alias("salt")
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    sent = table.select("*", F.explode(F.when(hot, every).otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
    return rows.select("*", salt).join(sent, [key, *also, "salt"]).drop("salt")
