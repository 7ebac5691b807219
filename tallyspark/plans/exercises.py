"""SQL exercises (M16 retention, W5/W6 year-on-year, A18 packing, A15/A16 median).

* retention: a correlated EXISTS becomes a ``left_semi`` join on
  (user, previous-period key); no pairs of actions are ever formed.
* packing: the prime class's batch and the area are scalar subqueries inside the
  plan (NULL without a row) -- no join, no cross join.
* median of a frequency table: ``selection.exact_quantile`` with weights is exact
  and never expands rows (the reference multiplies rows with generate_series).
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numeric import MONEY
from tallyspark.operators.measures import count_where
from tallyspark.operators.selection import exact_quantile
from tallyspark.operators.windows import lag_growth
from tallyspark.sources.tables import tables


def user_actions(t: tables) -> DataFrame:
    """User actions: (user_id, event_date) from orders."""
    return t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("event_date"))


def retention(actions: DataFrame, month: int, year: int, match_year: bool = True) -> DataFrame:
    """Users active in (year, month) who were also active in the previous month.

    ``match_year=False`` reproduces the month-number-only comparison (the
    previous month of any year counts).  The previous period is a constant of
    the report, so the "last month" side is filtered to it before the semi
    join: the filter reaches the scan and only that period is shuffled.
    """
    first = date(year, month, 1)
    last_day = (first.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
    prev = first - timedelta(days=1)
    # a date range (not month()/year() calls) so the filter reaches the scan
    curr = actions.filter(F.col("event_date").between(F.lit(first), F.lit(last_day)))
    if match_year:
        last = actions.filter(F.col("event_date").between(F.lit(prev.replace(day=1)), F.lit(prev)))
    else:
        last = actions.filter(F.month("event_date") == prev.month)
    last = last.select(F.col("user_id").alias("__u")).distinct()
    kept = curr.join(last, curr.user_id == last.__u, "left_semi")
    return kept.groupBy(F.month("event_date").alias("mth")).agg(
        F.countDistinct("user_id").cast("bigint").alias("monthly_active_users")
    )


def yoy_growth(t: tables) -> DataFrame:
    """Total spend per (product, year), previous year's spend, growth % rounded to 2."""
    tx = t.orders.select(
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("product_id"),
        F.col("o_totalprice").cast(MONEY).alias("spend"),
    )
    per_year = tx.groupBy("product_id", "year").agg(F.sum("spend").cast("double").alias("curr_year_spend"))
    return lag_growth(per_year, "product_id", "year", "curr_year_spend", "prev_year_spend", "yoy_rate", 2).select(
        "year", "product_id", "curr_year_spend", "prev_year_spend", "yoy_rate"
    )


PRIME, NOT_PRIME = "prime_eligible", "not_prime"


def inventory(t: tables) -> DataFrame:
    """Inventory items from parts: PROMO parts are prime-eligible, area = size."""
    return t.part.select(
        F.when(F.col("p_type") == "PROMO", F.lit(PRIME)).otherwise(F.lit(NOT_PRIME)).alias("item_type"),
        F.col("p_size").cast("bigint").alias("square_footage"),
    )


def warehouse_packing(inv: DataFrame, area: int | DataFrame = 500_000) -> DataFrame:
    """Whole batches of prime items that fit, then non-prime items in the remaining area.

    The prime class's batch and the area (a number, or a one-row table with the
    column ``area``) are scalar subqueries inside the plan: without a row they
    are NULL, so without prime items the other class's count is NULL.
    """
    known = [F.col("item_type") == PRIME, F.col("item_type") == NOT_PRIME]
    classes = inv.filter(known[0] | known[1]).groupBy("item_type").agg(
        F.sum("square_footage").alias("sqft"), F.count(F.lit(1)).alias("cnt"))
    room = area.select("area").scalar() if isinstance(area, DataFrame) else F.lit(area)
    prime = classes.filter(known[0]).select("sqft").scalar()
    rows = classes.withColumns({"room": room.cast("long"), "prime": prime.cast("long")}).withColumn(
        "batches", F.expr("CASE WHEN prime <> 0 THEN room div prime END"))
    count = F.when(known[0], F.col("batches") * F.col("cnt")).otherwise(
        F.expr("CASE WHEN sqft <> 0 THEN (room - batches * prime) div sqft END") * F.col("cnt"))
    return rows.select("item_type", count.cast("bigint").alias("item_count"))


def search_frequency(t: tables) -> DataFrame:
    """(searches, num_users): how many users made each number of 'view' events."""
    per_user = t.events.filter(F.col("event_type") == "view").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("searches"))
    return per_user.groupBy("searches").agg(F.count(F.lit(1)).alias("num_users"))


def frequency_median(freq: DataFrame, combine: str = "max") -> DataFrame:
    """Median of the multiset where each ``searches`` value repeats ``num_users`` times (NULL if it is empty)."""
    agg = F.max if combine == "max" else F.sum
    per_value = freq.groupBy("searches").agg(agg("num_users").alias("n")).filter(F.col("n") >= 1)
    found = exact_quantile(per_value, "searches", weight="n")
    return found.agg(F.round(F.max("quantile"), 1).alias("median"))


def price_medians(t: tables) -> DataFrame:
    """Median line price by return flag and line status (three flags hold all rows: hot groups)."""
    found = exact_quantile(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return found.select("l_returnflag", "l_linestatus", F.round("quantile", 4).alias("median_price"), F.col("n").alias("lines"))
