"""Insurance cross-sell: product composition per client (P1-P5) and the
fan-out-safe cross-sell matrix (M14, M15).

Scale notes
-----------
* The reference attaches three product groups to every anchor contract with
  many-to-many left joins, which multiplies rows and inflates sums.  Here every
  group is pre-aggregated per (client, group, contract) and then per client in
  a second partial aggregation: two map-side combined reductions, no join
  between policy rows, and a client with a third of all rows is reduced in
  every map task before any shuffle.
* Composition signatures collect the distinct product types of a client's week;
  the number of product types bounds the list.
* Full per-client ranking uses the range-partitioned ``rank_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import iso_week, iso_year, yyyy_mm_label
from tallyspark.functions.numeric import MONEY
from tallyspark.operators.classify import count_bucket, first_match, size_bucket
from tallyspark.operators.distinct import id_bitmaps
from tallyspark.operators.measures import count_where
from tallyspark.operators.pivoting import composition_signature, pivot_top_n, positional_crosstab, record_transpose
from tallyspark.operators.windows import rank_rows
from tallyspark.session import materialize, scratch_dir
from tallyspark.sources import adapters as ad
from tallyspark.sources.adapters import DEFAULT, Params
from tallyspark.sources.tables import snapshot_of, tables, write_snapshots

# Composition size labels by number of cross products.
SIZE_LABELS = ["mono", "one cross", "two cross", "three cross"]
SIZE_OVER = "4+ cross"
GROUPS = ("os", "ka", "ifl", "other")


def period_policies(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Client policies that start inside the cross-sell period."""
    pol = ad.policies(t)
    return pol.filter(F.col("bgn_dt").between(F.lit(p.cross_from), F.lit(p.cross_to)))


# --- q19 (P1) ---------------------------------------------------------------------

def type_slots(t: tables, p: Params = DEFAULT, n: int = 3) -> DataFrame:
    """Q19: per client, its sorted distinct product types in ``n`` positional slots."""
    pol = period_policies(t, p).select("rgs_id", F.upper("ins_type").alias("ins_type")).distinct()
    return positional_crosstab(pol, "rgs_id", "ins_type", n, prefix="ins_type")


# --- q20 (P4, P5) -------------------------------------------------------------------

def weekly_signatures(t: tables, p: Params = DEFAULT) -> DataFrame:
    """One row per (ISO year, ISO week, client) with its product signature."""
    pol = period_policies(t, p).select(
        iso_year("bgn_dt").alias("bgn_dt_year"), iso_week("bgn_dt").alias("week_num"), "rgs_id",
        F.upper("ins_type").alias("ins_type"),
    )
    week = ["bgn_dt_year", "week_num", "rgs_id"]
    sig = composition_signature(pol, week, "ins_type", p.signature_items, "&", "ins_type_gr")
    has = pol.groupBy(*week).agg(F.max((F.col("ins_type") == p.anchor_type).cast("int")).alias("has_anchor"))
    sig = sig.join(has, week)
    return sig.select(
        "bgn_dt_year", "week_num", "rgs_id", "ins_type_gr",
        size_bucket(F.col("ins_type_gr_size").cast("int") - 1, SIZE_LABELS, SIZE_OVER).alias("cross_cl"),
        F.when(F.col("has_anchor") == 1, F.lit(f"has {p.anchor_type}"))
        .otherwise(F.lit(f"no {p.anchor_type}")).alias("anchor_flg"),
    )


def weekly_composition(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q20: clients per (ISO year, week, signature, size class, anchor flag)."""
    sig = weekly_signatures(t, p)
    # one row per (week, client) already, so counting rows counts distinct clients
    return sig.groupBy("bgn_dt_year", "week_num", "ins_type_gr", "cross_cl", "anchor_flg").agg(
        F.count("rgs_id").cast("bigint").alias("cl_cnt"))


# --- q21 / q21b / q22 (M14, M15) ------------------------------------------------------

def _group(p: Params):
    u = F.upper(F.col("ins_type"))
    return first_match([
        (u == p.anchor_type, "os"),
        (u.isin(list(p.kasko_types)), "ka"),
        (u.isin(list(p.ifl_types)), "ifl"),
    ], "other")


def client_matrix(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Per anchor client and anchor month: anchor counts, sums and best rank of the month, and the client's
    counts and sums (DECIMAL) of every other product group in the period.

    The anchor side is reduced to (client, month) and the other groups to the
    client before they meet, so no join multiplies policy rows.
    """
    pol = period_policies(t, p).withColumn("grp", _group(p))
    per_contract = pol.groupBy("rgs_id", "grp", "con_id", yyyy_mm_label("bgn_dt").alias("mon")).agg(
        F.sum(F.col("ins_pay").cast(MONEY)).alias("pay"))
    anchor = per_contract.filter(F.col("grp") == "os").groupBy("rgs_id", "mon").agg(
        F.count("con_id").cast("bigint").alias("os_con_cnt"), F.sum("pay").alias("os_con_sum"))
    aggs = []
    for g in GROUPS[1:]:
        is_g = F.col("grp") == g
        aggs += [count_where(is_g).alias(f"{g}_con_cnt"), F.sum(F.when(is_g, F.col("pay"))).alias(f"{g}_con_sum")]
    others = per_contract.filter(F.col("grp") != "os").groupBy("rgs_id").agg(*aggs)
    ranks = rank_anchor_contracts(t, p).groupBy("rgs_id", yyyy_mm_label("bgn_dt").alias("mon")).agg(
        F.min("rn_rub_os").alias("best_rank"))
    # client snapshot: first contract date ever (J: client-level, joined after the reduction)
    fst = t.orders.groupBy(F.col("o_custkey").alias("rgs_id")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("fst_bgn_con_dt"))
    # region names: text codes cast to int for the join
    subj = t.nation.select(F.col("n_nationkey").cast("string").alias("subject_federation_code"),
                           F.col("n_name").alias("subject_federation_name"))
    cust = t.customer.select(F.col("c_custkey").alias("rgs_id"), F.col("c_nationkey").alias("con_region"))
    out = (anchor.join(ranks, ["rgs_id", "mon"], "left").join(others, "rgs_id", "left")
           .join(fst, "rgs_id", "left").join(cust, "rgs_id", "left")
           .join(subj, F.col("con_region") == subj.subject_federation_code.cast("int"), "left"))
    first_time = F.when(F.col("fst_bgn_con_dt").between(F.lit(p.report_from), F.lit(p.report_to)), 1).otherwise(0)
    return out.select(
        "rgs_id", "subject_federation_name", "fst_bgn_con_dt", first_time.alias("first_time_client"),
        F.col("mon").alias("osago_yr_mn"), "best_rank", "os_con_cnt", "os_con_sum",
        *[c for g in GROUPS[1:] for c in (F.coalesce(f"{g}_con_cnt", F.lit(0)).cast("bigint").alias(f"{g}_con_cnt"),
                                          F.col(f"{g}_con_sum"))],
    )


def cross_sell(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q21: the matrix of anchor clients and months with money sums as double."""
    m = client_matrix(t, p)
    return m.select(*[F.col(c).cast("double").alias(c) if c.endswith("_sum") else F.col(c) for c in m.columns])


def cross_sell_agg(t: tables, p: Params = DEFAULT) -> DataFrame:
    """The matrix aggregated by anchor month, region and first-time flag."""
    m = client_matrix(t, p)
    aggs = [F.count("rgs_id").cast("bigint").alias("clients")]
    for g in GROUPS:
        aggs += [F.sum(f"{g}_con_cnt").cast("bigint").alias(f"{g}_con_cnt"),
                 F.sum(f"{g}_con_sum").cast("double").alias(f"{g}_con_sum")]
    return m.groupBy("osago_yr_mn", "subject_federation_name", "first_time_client").agg(*aggs)


def client_groups(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q22: distinct client-group codes (four count buckets concatenated)."""
    m = client_matrix(t, p)
    labels = {"os": "over 3 osago", "ka": "over 3 kasko", "ifl": "over 3 ifl", "other": "over 3 other"}
    gr = F.concat(*[count_bucket(F.col(f"{g}_con_cnt"), 3, labels[g]) for g in GROUPS])
    return m.select(gr.alias("client_gr")).distinct()


# --- q23 (D8, A2, A17) ---------------------------------------------------------------

def week_bitmaps(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Clients by ISO week as bitmaps: all of the source, and those that have a signature (a product type)."""
    pol = period_policies(t, p).select(iso_year("bgn_dt").alias("bgn_dt_year"), iso_week("bgn_dt").alias("week_num"),
                                       "rgs_id", "ins_type")
    return id_bitmaps(pol, ["bgn_dt_year", "week_num"], "rgs_id",
                      {"source": None, "result": F.col("ins_type").isNotNull()})


def reconcile(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Distinct clients in the source vs in the weekly signatures, and the difference.

    The policies are read once, into bitmaps by week; source, result and weekly
    counts are all taken from these: OR over the weeks, then count; count, then sum.
    """
    per_bucket = week_bitmaps(t, p).groupBy("bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("source")).alias("s"), F.bitmap_count(F.bitmap_or_agg("result")).alias("r"),
        F.sum(F.bitmap_count("result")).alias("w"))
    one = per_bucket.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("source_clients"),
                         F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("result_clients"),
                         F.sum("w").cast("bigint").alias("weekly_client_sum"))
    return one.withColumn("delta", F.col("source_clients") - F.col("result_clients"))


def trailing_clients(t: tables, p: Params = DEFAULT, weeks: int = 4) -> DataFrame:
    """Distinct clients of each week and of the ``weeks`` weeks that end with it, from the stored bitmaps.

    A week is numbered by its Monday, so spans run across the turn of a year.
    """
    stored = materialize(week_bitmaps(t, p), "week_bitmaps")
    monday = F.expr("date_add(make_date(bgn_dt_year, 1, 4), 7 * (week_num - 1) - weekday(make_date(bgn_dt_year, 1, 4)))")
    week = stored.withColumn("monday", monday)
    spans = week.select("bucket", "result", "monday", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(weeks - 1)), lambda k: F.date_add("monday", 7 * k))).alias("week_start"))
    own = F.when(F.col("monday") == F.col("week_start"), F.col("result"))
    per = spans.groupBy("week_start", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("result")).alias("n"),
                                                    F.bitmap_count(F.max(own)).alias("own"))
    out = per.groupBy("week_start").agg(F.sum("own").cast("bigint").alias("week_clients"),
                                        F.sum("n").cast("bigint").alias("span_clients"))
    return out.filter(F.col("week_clients").isNotNull())


def snapshot_month(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Clients, policies and payments by type in the report month's snapshot of the policies.

    The policies are stored by month; the month is read from a parameter table
    when the query runs, and only its folder is scanned.
    """
    spark = t.spark
    pol = ad.policies(t).withColumn("snapshot", yyyy_mm_label("bgn_dt"))
    path = scratch_dir(spark, "snapshots")
    write_snapshots(pol, path, "snapshot")
    stored = spark.read.schema(pol.schema).parquet(path)
    params = materialize(spark.range(1).select(F.lit("report").alias("name"),
                                               yyyy_mm_label(F.lit(p.report_from)).alias("snapshot")), "params")
    month = snapshot_of(stored, "snapshot", params.filter(F.col("name") == "report"))
    return month.groupBy("snapshot", "ins_type").agg(
        F.countDistinct("rgs_id").alias("clients"), F.count(F.lit(1)).alias("policies"),
        F.sum(F.col("ins_pay").cast(MONEY)).cast("double").alias("paid"))


# --- q24 / q24b (P2, P3, W3) -------------------------------------------------------------

def transpose_order():
    """Total record order for the transpose (start, contract, end, type, payment)."""
    return [F.col("bgn_dt").asc(), F.col("con_id").asc(), F.col("end_dt").asc(), F.col("ins_type").asc(),
            F.col("ins_pay").asc()]


def transpose_records(t: tables, n: int = 3) -> DataFrame:
    """Q24: each client's first ``n`` policy records transposed into r1..rn."""
    pol = ad.policies(t).withColumn("ins_pay", F.col("ins_pay").cast(MONEY))
    return record_transpose(pol, "rgs_id", transpose_order(), ["con_id", "ins_type", "bgn_dt", "end_dt", "ins_pay"], n)


def top_order():
    """Total record order for the top-n pivot (type desc, contract, payment desc, dates)."""
    return [F.col("ins_type").desc(), F.col("con_id").asc(), F.col("ins_pay").desc(), F.col("bgn_dt").asc(),
            F.col("end_dt").asc()]


def top_records_pivot(t: tables, n: int = 5) -> DataFrame:
    """Each client's top ``n`` records pivoted into numbered columns."""
    pol = ad.policies(t)
    return pivot_top_n(pol, "rgs_id", top_order(), ["con_id", "ins_pay"], n, extra=["ins_type"])


# --- q25 (W2) ---------------------------------------------------------------------------

def rank_anchor_contracts(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q25: de-duplicated anchor contracts, with their begin, ranked per client by payment (skew-safe)."""
    pol = period_policies(t, p).filter(F.col("ins_type") == p.anchor_type)
    distinct = pol.select("con_id", "ins_pay", "rgs_id", "bgn_dt").distinct()
    return rank_rows(distinct, "rgs_id", [F.col("ins_pay").desc_nulls_last(), F.col("con_id").asc()], "rn_rub_os")
