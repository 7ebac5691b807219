"""Query catalogue: SURVEY §7.3 keys -> callables (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans import cross_sell as cs
from tallyspark.plans import exercises as ex
from tallyspark.plans import gates as gt
from tallyspark.plans import panel as pn
from tallyspark.plans import product_etl as pe
from tallyspark.plans import retail_star as rs
from tallyspark.session import materialize, scratch_dir
from tallyspark.sources import adapters as ad
from tallyspark.sources import io as sio
from tallyspark.sources.tables import tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(key: str):
    """Register a catalogue function under ``key``."""
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# --- retail star schema (M1-M7) ---------------------------------------------

def _raw(spark, sf_dir):
    return ad.raw_invoices(tables(spark, sf_dir))


@query("q26_dims")
def q26_dims(spark, sf_dir):
    return rs.dim_product(_raw(spark, sf_dir))


@query("q27_dim_customer")
def q27_dim_customer(spark, sf_dir):
    t = tables(spark, sf_dir)
    return rs.dim_customer(ad.raw_invoices(t), ad.country_reference(t))


@query("q28_dim_datetime")
def q28_dim_datetime(spark, sf_dir):
    return rs.dim_datetime(_raw(spark, sf_dir))


@query("q29_fact")
def q29_fact(spark, sf_dir):
    return rs.fct_invoices(_raw(spark, sf_dir))


@query("q29b_fact_joined")
def q29b_fact_joined(spark, sf_dir):
    """The star join: fact rows that find their datetime, product and customer."""
    t = tables(spark, sf_dir)
    raw = ad.raw_invoices(t)
    return rs.fct_invoices(raw, "join", {"customer": rs.dim_customer(raw, ad.country_reference(t))})


@query("q30c_top_countries_joined")
def q30c_top_countries_joined(spark, sf_dir):
    t = tables(spark, sf_dir)
    raw = ad.raw_invoices(t)
    dims = rs.dim_customer(raw, ad.country_reference(t))
    return rs.report_customer_invoices(rs.fct_invoices(raw), dims)


@query("q30_top_countries")
def q30_top_countries(spark, sf_dir):
    t = tables(spark, sf_dir)
    return rs.report_customer_invoices_1pass(ad.raw_invoices(t), ad.country_reference(t))


@query("q30b_top_products")
def q30b_top_products(spark, sf_dir):
    return rs.report_product_invoices_1pass(_raw(spark, sf_dir))


@query("q31_monthly")
def q31_monthly(spark, sf_dir):
    return rs.report_year_invoices_1pass(_raw(spark, sf_dir))


# --- plan-vs-fact panel and contract features (M9-M13) ------------------------


@query("q01_city_label")
def q01_city_label(spark, sf_dir):
    return pn.city_counts(tables(spark, sf_dir))


@query("q02_contract_panel")
def q02_contract_panel(spark, sf_dir):
    return pn.contract_panel(tables(spark, sf_dir))


@query("q03_programme_rules")
def q03_programme_rules(spark, sf_dir):
    return pn.programme_rules(tables(spark, sf_dir))


@query("q03c_contract_features")
def q03c_contract_features(spark, sf_dir):
    return pn.contract_features(tables(spark, sf_dir))


@query("q03d_rule_ladder")
def q03d_rule_ladder(spark, sf_dir):
    return pn.rule_ladder(tables(spark, sf_dir))


@query("q04_membership_flags")
def q04_membership_flags(spark, sf_dir):
    return pn.membership_flags(tables(spark, sf_dir))


@query("q05_penetration")
def q05_penetration(spark, sf_dir):
    t = tables(spark, sf_dir)
    return pn.penetration_table(pn.contract_panel(t))


@query("q06_weighted_rates")
def q06_weighted_rates(spark, sf_dir):
    return pn.weighted_rates(tables(spark, sf_dir))


@query("q07_plan_totals")
def q07_plan_totals(spark, sf_dir):
    return pn.plan_totals(tables(spark, sf_dir))


@query("q08_fact_brand_split")
def q08_fact_brand_split(spark, sf_dir):
    return pn.fact_splits(tables(spark, sf_dir)).select("mac", "fp_count_fact", "nefp_count_fact")


@query("q09_fact_like_split")
def q09_fact_like_split(spark, sf_dir):
    return pn.fact_splits(tables(spark, sf_dir)).select("mac", "asp_d_count_fact", "c2c_count_fact", "ab_count_fact")


@query("q09b_fact_part_like_split")
def q09b_fact_part_like_split(spark, sf_dir):
    return pn.fact_part_like_split(tables(spark, sf_dir))


@query("q10_latest_row")
def q10_latest_row(spark, sf_dir):
    return pn.latest_policy(tables(spark, sf_dir))


@query("q10b_status_history")
def q10b_status_history(spark, sf_dir):
    return pn.client_status_history(tables(spark, sf_dir))


@query("q11_role_flags")
def q11_role_flags(spark, sf_dir):
    return pn.cancellation_flags(tables(spark, sf_dir))


@query("q12_residual_plan")
def q12_residual_plan(spark, sf_dir):
    return pn.residual_plan(tables(spark, sf_dir))


@query("q13_plan_vs_fact")
def q13_plan_vs_fact(spark, sf_dir):
    return pn.plan_vs_fact(tables(spark, sf_dir))


# --- SQL exercises (M16, W5/W6, A18, A15/A16) -----------------------------------


@query("q14_retention")
def q14_retention(spark, sf_dir):
    return ex.retention(ex.user_actions(tables(spark, sf_dir)), 7, 1997, match_year=True)


@query("q14_retention_month_only")
def q14_retention_month_only(spark, sf_dir):
    return ex.retention(ex.user_actions(tables(spark, sf_dir)), 7, 1997, match_year=False)


@query("q15_yoy")
def q15_yoy(spark, sf_dir):
    return ex.yoy_growth(tables(spark, sf_dir))


@query("q17_packing")
def q17_packing(spark, sf_dir):
    area = spark.range(1).select(F.lit(500_000).alias("area"))
    return ex.warehouse_packing(ex.inventory(tables(spark, sf_dir)), area)


@query("q18_frequency_median")
def q18_frequency_median(spark, sf_dir):
    return ex.frequency_median(ex.search_frequency(tables(spark, sf_dir)))


@query("q18b_price_medians")
def q18b_price_medians(spark, sf_dir):
    return ex.price_medians(tables(spark, sf_dir))


# --- cross-sell and crosstabs (P1-P5, M14, M15) ------------------------------------

@query("q19_positional_crosstab")
def q19_positional_crosstab(spark, sf_dir):
    return cs.type_slots(tables(spark, sf_dir))


@query("q20_composition_weekly")
def q20_composition_weekly(spark, sf_dir):
    return cs.weekly_composition(tables(spark, sf_dir))


@query("q21_cross_sell")
def q21_cross_sell(spark, sf_dir):
    return cs.cross_sell(tables(spark, sf_dir))


@query("q21b_cross_sell_agg")
def q21b_cross_sell_agg(spark, sf_dir):
    return cs.cross_sell_agg(tables(spark, sf_dir))


@query("q22_client_groups")
def q22_client_groups(spark, sf_dir):
    return cs.client_groups(tables(spark, sf_dir))


@query("q23_reconcile")
def q23_reconcile(spark, sf_dir):
    return cs.reconcile(tables(spark, sf_dir))


@query("q23b_trailing_clients")
def q23b_trailing_clients(spark, sf_dir):
    return cs.trailing_clients(tables(spark, sf_dir))


@query("q23c_snapshot_month")
def q23c_snapshot_month(spark, sf_dir):
    return cs.snapshot_month(tables(spark, sf_dir))


@query("q24_transpose")
def q24_transpose(spark, sf_dir):
    return cs.transpose_records(tables(spark, sf_dir))


@query("q24b_top5_pivot")
def q24b_top5_pivot(spark, sf_dir):
    return cs.top_records_pivot(tables(spark, sf_dir))


@query("q25_rank_contracts")
def q25_rank_contracts(spark, sf_dir):
    return cs.rank_anchor_contracts(tables(spark, sf_dir))


# --- product ETL, quality gates, copies and CSV (M8, D1-D7, S3-S6, O3) ---------------


# Tables the product ETL looks for (one is absent on purpose).
COPY_CANDIDATES = ["part", "nation", "region", "supplier", "customer", "product_subcategory_missing"]


@query("q32_product_snowflake")
def q32_product_snowflake(spark, sf_dir):
    return pe.product_snowflake(tables(spark, sf_dir))


@query("q33_gates")
def q33_gates(spark, sf_dir):
    t = tables(spark, sf_dir)
    return gt.gate_results(ad.raw_invoices(t), ad.country_reference(t), store=materialize)


@query("q33b_failed_rows")
def q33b_failed_rows(spark, sf_dir):
    return gt.failed_invoice_rows(ad.raw_invoices(tables(spark, sf_dir)))


@query("q37_released_twice")
def q37_released_twice(spark, sf_dir):
    t = tables(spark, sf_dir)
    return gt.released_twice(ad.raw_invoices(t), ad.country_reference(t))


@query("q34_load_audit")
def q34_load_audit(spark, sf_dir):
    names = sio.discover_tables(spark, sf_dir, COPY_CANDIDATES)
    audit = sio.copy_tables(spark, sf_dir, names, scratch_dir(spark, "staging"), prefix="src_")
    return audit.select("table_name", "rows_imported")


@query("q34b_copy_status")
def q34b_copy_status(spark, sf_dir):
    """All candidates copied at once, the absent one too: its failure is reported, the others are loaded."""
    audit = sio.copy_tables(spark, sf_dir, COPY_CANDIDATES, scratch_dir(spark, "staging"), on_error="report")
    return audit.select("table_name", "rows_imported", (F.col("seconds") >= 0).alias("timed"),
                        F.substring_index("status", ":", 1).alias("outcome"))


@query("q35b_csv_quarantine")
def q35b_csv_quarantine(spark, sf_dir):
    """Raw invoices as CSV lines, some spoilt by rule, split into typed and rejected ones."""
    raw = ad.raw_invoices(tables(spark, sf_dir))
    line = F.to_csv(F.struct(*raw.columns))
    word = F.to_csv(F.struct(*[F.lit("many").alias(c) if c == "Quantity" else F.col(c) for c in raw.columns]))
    kind = F.col("InvoiceNo").cast("long") % 7
    spoilt = (F.when(kind == 0, F.regexp_replace(line, ",[^,]*$", "")).when(kind == 1, F.concat(line, F.lit(",more")))
              .when(kind == 2, word).otherwise(line))
    path = scratch_dir(spark, "spoilt_csv")
    raw.select(spoilt.alias("value")).write.text(path)
    typed, rejected = sio.read_csv_quarantine(spark, path, header=False)
    return typed.select(F.lit("typed").alias("outcome"), "Quantity").unionByName(
        rejected.select(F.lit("rejected").alias("outcome"), F.lit(None).cast("int").alias("Quantity"))).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("Quantity").alias("quantity"))


@query("q35_csv_raw")
def q35_csv_raw(spark, sf_dir):
    path = scratch_dir(spark, "raw_invoices_csv")
    sio.write_csv(ad.raw_invoices(tables(spark, sf_dir)), path)
    return sio.read_csv_typed(spark, path)


@query("q36_sorted_limit")
def q36_sorted_limit(spark, sf_dir):
    c = ad.contracts(tables(spark, sf_dir))
    return (c.select("contract_id", "issue_dt", "loan_amt", "city")
            .orderBy(F.asc("issue_dt"), F.asc("contract_id")).limit(1000))
