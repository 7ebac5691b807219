"""Join helpers.

No join here is forced to broadcast: Spark compares the sides' sizes in bytes
with its threshold, from statistics and again at run time, and shuffles (and
splits skewed partitions) beyond it.  Dated lookups need no range join: few
intervals are a CASE expression, many are merged with the rows in one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.windows import rank_rows
from tallyspark.session import drop_scratch, store


def left_lookup(df: DataFrame, dim: DataFrame, on, right_filter: Column | None = None) -> DataFrame:
    """Left join whose constant predicates apply to the right side only."""
    if right_filter is not None:
        dim = dim.filter(right_filter)
    return df.join(dim, on, "left")


def role_flags(df: DataFrame, key: str, roles_df: DataFrame, role_key: str, role_col: str,
               roles: dict[str, object]) -> DataFrame:
    """Same table in several roles -> presence flags.

    One partial-aggregated ``groupBy(key)`` computes every flag, then one left
    join attaches them; the role table is scanned once, not once per role.
    """
    aggs = [F.max(F.when(F.col(role_col) == F.lit(v), 1)).alias(name) for name, v in roles.items()]
    flags = roles_df.groupBy(F.col(role_key).alias(key)).agg(*aggs)
    out = df.join(flags, key, "left")
    return out.select(*df.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in roles])


#: Interval tables up to this many rows become a search tree of CASE expressions; larger ones are merged with the rows.
TREE_INTERVALS = 256


def resolve_effective_rules(rules: DataFrame, value: str, valid_from: str = "valid_from",
                            valid_to: str = "valid_to", priority: str = "priority") -> DataFrame:
    """Overlapping dated rules -> non-overlapping intervals (lowest ``priority`` wins).

    The rule boundaries cut the time line into numbered pieces.  A rule covers a
    range of numbers, which a segment tree's blocks make up: at most two blocks
    a level, however long or open-ended the rule.  Each piece looks up its block
    of every level and keeps the first-priority rule, so rules and pieces meet
    in an equi-join of (rules + pieces) * log(pieces) rows.
    Output: (valid_from, valid_to, value); stretches without a rule are absent.
    """
    r = rules.select(F.col(valid_from).cast("date").alias("f"), F.col(valid_to).cast("date").alias("t"),
                     F.col(value).alias("v"), F.col(priority).alias("p")).filter("f <= t")
    cuts = r.select(F.col("f").alias("c")).union(r.select(F.date_add("t", 1).alias("c"))).distinct()
    numbered = rank_rows(cuts.select("c", F.lit(0).alias("g")), "g", [F.col("c").asc()], "i").select(
        "c", (F.col("i").cast("long") - 1).alias("i"))
    levels = max(1, int(numbered.count()).bit_length())
    after = numbered.select((F.col("i") - 1).alias("i"), F.date_sub("c", 1).alias("e"))
    pieces = numbered.select("i", F.col("c").alias("s")).join(after, "i")

    def blocks(k: Column) -> Column:
        # the rule's range of numbers [lo, hi) at level k; an odd end is a block of its own
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        lo, hi = F.ceil(F.col("lo") / size), F.floor(F.col("hi") / size)
        own = [F.when((lo < hi) & (lo % 2 == 1), F.struct(k.alias("k"), lo.cast("long").alias("b"))),
               F.when((lo < hi) & (hi % 2 == 1), F.struct(k.alias("k"), (hi - 1).cast("long").alias("b")))]
        return F.filter(F.array(*own), lambda x: x.isNotNull())

    ranged = (r.join(numbered.select(F.col("c").alias("f"), F.col("i").alias("lo")), "f")
              .join(numbered.select(F.col("c").alias("u"), F.col("i").alias("hi")), F.date_add("t", 1) == F.col("u")))
    first = ranged.select("p", "v", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), blocks))).alias("x")).groupBy(
        F.col("x.k").alias("k"), F.col("x.b").alias("b")).agg(F.min(F.struct("p", "v")).alias("best"))
    looked = pieces.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("b", F.expr("shiftright(i, k)"))
    best = looked.join(first, ["k", "b"]).groupBy("s", "e").agg(F.min("best").alias("b"))
    return best.select(F.col("s").alias(valid_from), F.col("e").alias(valid_to), F.col("b.v").alias(value))


def _search_tree(at: Column, intervals: list[tuple], kind) -> Column:
    """The value of the (sorted) interval that holds ``at``: a balanced tree of comparisons, log2(n) deep."""
    if not intervals:
        return F.lit(None).cast(kind)
    if len(intervals) == 1:
        f, t, v = intervals[0]
        return F.when((at >= F.lit(f)) & (at <= F.lit(t)), F.lit(v).cast(kind)).otherwise(F.lit(None).cast(kind))
    mid = len(intervals) // 2
    return F.when(at < F.lit(intervals[mid][0]), _search_tree(at, intervals[:mid], kind)).otherwise(
        _search_tree(at, intervals[mid:], kind))


def _carried(df: DataFrame, date_col: str, intervals: DataFrame) -> DataFrame:
    """Rows and interval starts in one range-partitioned order; every row takes the last start before it.

    Equal dates are spread by a hash of the row, so one hot day is dealt over
    many partitions.  A start that lies in an earlier partition comes from a
    table of one row per partition.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"),
                     F.col(date_col).cast("date").alias("at"), F.lit(1).alias("kind"), F.xxhash64(*df.columns).alias("spread"))
    starts = intervals.select(F.col("f").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("spread"),
                              F.struct("f", "t", "v").alias("rule"))
    order = [F.col("at").asc_nulls_first(), F.col("kind").asc(), F.col("spread").asc()]
    ranged = rows.unionByName(starts, allowMissingColumns=True).repartitionByRange(
        int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    merged, path = store(ranged.withColumn("piece", F.spark_partition_id()), "merged")
    ends = merged.filter("kind = 0").groupBy("piece").agg(F.max_by("rule", "at").alias("last"))
    all_pieces = merged.select("piece").distinct().join(ends, "piece", "left")
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carry = all_pieces.withColumn("carry", F.last("last", ignorenulls=True).over(before)).select("piece", "carry")
    inside = Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = merged.withColumn("own", F.last("rule", ignorenulls=True).over(inside)).filter("kind = 1")
    met = own.join(carry, "piece").withColumn("rule", F.coalesce("own", "carry"))
    value = F.when(F.col("at") <= F.col("rule.t"), F.col("rule.v"))
    out, _ = store(met.select("row", value.alias("v")), "carried")
    drop_scratch(spark, path)
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)], "v")


def effective_dated_lookup(df: DataFrame, date_col: str, intervals: DataFrame, value: str,
                           valid_from: str = "valid_from", valid_to: str = "valid_to", out: str | None = None,
                           tree_intervals: int = TREE_INTERVALS) -> DataFrame:
    """Attach the value of the (non-overlapping) interval containing ``date_col``; NULL if none.

    Up to ``tree_intervals`` intervals are read into a search tree of CASE
    expressions, which needs no join.  More are merged with the rows in one
    range-partitioned order and carried forward; no key by year, no copies of
    open-ended intervals, and a hot day is split.  Both give the same result.
    """
    out = out or value
    iv = intervals.select(F.col(valid_from).cast("date").alias("f"), F.col(valid_to).cast("date").alias("t"),
                          F.col(value).alias("v"))
    iv, path = store(iv, "intervals")
    few = iv.orderBy("f").limit(tree_intervals + 1).collect()  # at most tree_intervals + 1 rows
    if len(few) <= tree_intervals:
        drop_scratch(df.sparkSession, path)
        found = _search_tree(F.col(date_col), [tuple(x) for x in few], iv.schema["v"].dataType)
        return df.select(*df.columns, found.alias(out))
    done = _carried(df, date_col, iv)
    drop_scratch(df.sparkSession, path)
    return done.withColumnRenamed("v", out)
