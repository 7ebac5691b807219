"""End-to-end pipeline runs: each stage is written as a table (the reference's
drop + CTAS / replace-on-write), and later stages read the stored tables.

Stored stages cut lineage (a lost executor only recomputes from the last
stored table) and let several later stages read one computed result.  Paths
live under ``out_dir`` -- a shared folder on a cluster.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import cross_sell as cs
from tallyspark.plans import gates as gt
from tallyspark.plans import panel as pn
from tallyspark.plans import product_etl as pe
from tallyspark.plans import retail_star as rs
from tallyspark.sources import adapters as ad
from tallyspark.sources import io as sio
from tallyspark.sources.adapters import DEFAULT, Params
from tallyspark.sources.tables import tables


def _store(df: DataFrame, out_dir: str, name: str) -> DataFrame:
    path = os.path.join(out_dir, name)
    sio.replace_table(df, path)
    return df.sparkSession.read.parquet(path)


def run_panel(t: tables, out_dir: str, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """Contract panel -> penetration; rate panel -> weighted rates; final plan-vs-fact export."""
    panel = _store(pn.contract_panel(t, p), out_dir, "su_panel")
    pen = _store(pn.penetration_table(panel, p), out_dir, "su_penetration")
    rates = _store(pn.weighted_rates(t, p), out_dir, "sred_ves")
    report = _store(pn.plan_vs_fact(t, p, panel=panel), out_dir, "plan_vs_fact")
    return {"su_panel": panel, "su_penetration": pen, "sred_ves": rates, "plan_vs_fact": report}


def run_cross_sell(t: tables, out_dir: str, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """Weekly signatures and their report; client matrix, its aggregate and client groups."""
    sig = _store(cs.weekly_signatures(t, p), out_dir, "cross_signatures")
    weekly = sig.groupBy("bgn_dt_year", "week_num", "ins_type_gr", "cross_cl", "anchor_flg").count() \
        .withColumnRenamed("count", "cl_cnt")
    return {
        "cross_signatures": sig,
        "cross_weekly": _store(weekly, out_dir, "cross_weekly"),
        "cross_matrix": _store(cs.cross_sell(t, p), out_dir, "cross_matrix"),
        "cross_matrix_agg": _store(cs.cross_sell_agg(t, p), out_dir, "cross_matrix_agg"),
        "client_groups": _store(cs.client_groups(t, p), out_dir, "client_groups"),
    }


def run_retail(t: tables, out_dir: str) -> dict[str, DataFrame]:
    """raw -> gate -> dims + fact -> gate -> reports -> gate, every layer stored."""
    raw = _store(ad.raw_invoices(t), out_dir, "raw_invoices")
    country = ad.country_reference(t)
    stored: dict[str, DataFrame] = {"raw_invoices": raw}

    def keep(df: DataFrame, name: str) -> DataFrame:
        stored[name] = _store(df, out_dir, name)
        return stored[name]

    stored["gate_results"] = gt.enforce_all(raw, country, store=keep)
    stored["report_customer_invoices"] = _store(
        rs.report_customer_invoices(stored["fct_invoices"], stored["dim_customer"]), out_dir, "report_customer_invoices")
    stored["report_product_invoices"] = _store(
        rs.report_product_invoices(stored["fct_invoices"], stored["dim_product"]), out_dir, "report_product_invoices")
    stored["report_year_invoices"] = _store(
        rs.report_year_invoices(stored["fct_invoices"], stored["dim_datetime"]), out_dir, "report_year_invoices")
    return stored


# Source tables the product ETL copies.
PRODUCT_SOURCES = ["part"]


def run_product_etl(spark: SparkSession, src_dir: str, stage_dir: str) -> dict[str, DataFrame]:
    """discover -> copy (src_) -> clean (stg_) -> join (prd_), with a load audit of the copy."""
    names = sio.discover_tables(spark, src_dir, PRODUCT_SOURCES)
    audit = sio.copy_tables(spark, src_dir, names, stage_dir, prefix="src_")
    src = tables(spark, stage_dir, prefix="src_")
    stg_p = _store(pe.stg_product(pe.src_product(src)), stage_dir, "stg_product")
    stg_s = _store(pe.stg_subcategory(pe.src_subcategory(src)), stage_dir, "stg_product_subcategory")
    stg_c = _store(pe.stg_category(pe.src_category(src)), stage_dir, "stg_product_category")
    prd = _store(pe.product_model(stg_p, stg_s, stg_c), stage_dir, "prd_product")
    return {"audit": audit, "stg_product": stg_p, "stg_product_subcategory": stg_s,
            "stg_product_category": stg_c, "prd_product": prd}
