"""Exact order statistics by distributed selection.

``F.percentile`` keeps every distinct value of a group in one buffer.  Here
histogram rounds narrow the range that holds the wanted rank: each round is one
partially aggregated ``groupBy(group, bin)`` whose result (at most a few
thousand bins a group) says which bin the rank falls in, and how many rows lie
before it.  The first round bins by sign and binary exponent, later ones split
the range that is left evenly between the smallest and largest value in it, so
the range shrinks by the number of bins whatever the distribution.  When few
enough rows are left in a range, that slice alone is sorted.

A hot group costs no task more than another, nothing is collected but the
number of groups still open, and weights (how often a value counts) are summed,
never expanded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import drop_scratch, store

BINS = 4096
#: Weights are summed as whole decimals, so that totals beyond 2**63 stay exact.
TOTAL = "decimal(38,0)"


def _binade(v: Column) -> Column:
    """Sign and binary exponent of a double as one rising integer."""
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(5e-324)))) + 1100
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def _even(v: Column) -> Column:
    """Number of the even bin of [lo, hi] that holds ``v`` (halved first, so that the width cannot overflow)."""
    part = (v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    return F.when(F.col("hi") > F.col("lo"), F.least(F.floor(part * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("long")


def _same(group: Sequence[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in group:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _held(bins: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """The bin of each group that holds its rank: lo, hi, rows in it, and the rank inside it."""
    upto = F.sum("w").over(Window.partitionBy(*group).orderBy("bin"))
    run = bins.withColumn("upto", upto)
    met = run.alias("a").join(targets.alias("t"), _same(group, "a", "t")).filter(
        (F.col("t.rank") < F.col("a.upto")) & (F.col("t.rank") >= F.col("a.upto") - F.col("a.w")))
    return met.select(*[F.col(f"a.{c}") for c in group], "a.lo", "a.hi", "a.rows",
                      (F.col("t.rank") - (F.col("a.upto") - F.col("a.w"))).cast(TOTAL).alias("rank"))


def exact_quantile(df: DataFrame, value: str, group: Sequence[str] = (), weight: str | None = None,
                   part: tuple[int, int] = (1, 2), slice_rows: int = 100_000) -> DataFrame:
    """The continuous quantile ``part[0] / part[1]`` of ``value`` by group: (group..., quantile, n).

    Equals sorting the values (each repeated ``weight`` times) and interpolating
    between the two ranks around (n - 1) * part.  NULL and NaN values and
    weights below 1 are left out; NULL is a group of its own; a group without values
    is absent (without ``group``, an empty input gives no row).
    """
    spark = df.sparkSession
    num, den = part
    names = list(group) or ["__all"]
    keys = [F.col(c) for c in group] or [F.lit(0).alias("__all")]
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.select(*keys, F.col(value).cast("double").alias("v"), w.alias("w")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.col("w") >= 1))
    rows, rows_path = store(rows, "selection")
    paths = [rows_path]

    def summed(data: DataFrame, number: Column) -> DataFrame:
        return data.groupBy(*names, number.alias("bin")).agg(
            F.sum(F.col("w").cast(TOTAL)).cast(TOTAL).alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.count(F.lit(1)).alias("rows"))

    bins, path = store(summed(rows, _binade(F.col("v"))), "bins")
    paths.append(path)
    totals = bins.groupBy(*names).agg(F.sum("w").cast(TOTAL).alias("n"))
    at = (F.col("n") - 1) * F.lit(num).cast(TOTAL)
    targets, path = store(totals.select(*names, F.col("n"), F.floor((at - at % den) / den).cast(TOTAL).alias("rank"),
                                        ((at % den) / den).cast("double").alias("frac")), "ranks")
    paths.append(path)
    held, path = store(_held(bins, targets, names), "held")
    paths.append(path)
    done = held.filter("lo = hi OR rows <= {}".format(slice_rows))
    open_groups = held.filter("lo < hi AND rows > {}".format(slice_rows))
    data = rows
    while not open_groups.isEmpty():
        data, path = store(data.alias("a").join(open_groups.alias("b"), _same(names, "a", "b")).filter(
            F.col("a.v").between(F.col("b.lo"), F.col("b.hi"))).select("a.*", "b.lo", "b.hi"), "slice")
        paths.append(path)
        bins = summed(data, _even(F.col("v")))
        held, path = store(_held(bins, open_groups.select(*names, "rank"), names), "held")
        paths.append(path)
        data = data.select(*names, "v", "w")
        done = done.unionByName(held.filter("lo = hi OR rows <= {}".format(slice_rows)))
        open_groups = held.filter("lo < hi AND rows > {}".format(slice_rows))

    # the few rows of each slice, sorted
    some = rows.alias("a").join(done.filter("lo < hi").alias("b"), _same(names, "a", "b")).filter(
        F.col("a.v").between(F.col("b.lo"), F.col("b.hi"))).groupBy(*[F.col(f"a.{c}").alias(c) for c in names], "b.rank", "a.v").agg(
        F.sum(F.col("a.w").cast(TOTAL)).cast(TOTAL).alias("w"))
    upto = F.sum("w").over(Window.partitionBy(*names).orderBy("v"))
    found = some.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("w")))
    low = found.select(*names, "v", (F.col("upto") - F.col("rank")).alias("left"))
    # a range of one value: how much of its weight lies behind the rank
    one = done.filter("lo = hi")
    weights = rows.alias("a").join(one.alias("b"), _same(names, "a", "b")).filter(F.col("a.v") == F.col("b.lo")).groupBy(
        *[F.col(f"a.{c}").alias(c) for c in names], "b.rank", F.col("a.v").alias("v")).agg(
        F.sum(F.col("a.w").cast(TOTAL)).cast(TOTAL).alias("w"))
    low, path = store(low.unionByName(weights.select(*names, "v", (F.col("w") - F.col("rank")).alias("left"))), "low")
    paths.append(path)
    # the next rank is the same value, or the smallest one above it
    above = rows.alias("a").join(low.filter("left <= 1").alias("b"), _same(names, "a", "b")).filter(
        F.col("a.v") > F.col("b.v")).groupBy(*[F.col(f"a.{c}").alias(c) for c in names]).agg(F.min("a.v").alias("next"))
    both = low.alias("a").join(above.alias("b"), _same(names, "a", "b"), "left").join(
        targets.alias("t"), _same(names, "a", "t"))
    step = (F.coalesce(F.col("b.next"), F.col("a.v")) - F.col("a.v")) * F.col("t.frac")
    out, _ = store(both.select(*[F.col(f"a.{c}") for c in group], (F.col("a.v") + step).alias("quantile"),
                               F.col("t.n").cast("long").alias("n")), "quantiles")
    for p in paths:
        drop_scratch(spark, p)
    return out
