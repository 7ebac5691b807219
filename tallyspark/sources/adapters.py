"""Fixture adapters: the reference's warehouse inputs re-expressed over the driver tables.

Each adapter is a lazy projection/join; nothing is materialised.  Filters that
callers apply afterwards (periods, product lists) are pushed by Catalyst below
the joins and into the parquet scans.

Mapping (see FIXTURES.md, part B):
  contracts   orders x customer (+ office -> city label)
  offices     nation x region with a city override map
  insurance   lineitem rows as insurance policies of an agreement
  policies    lineitem x orders x part as insurance contracts of a client
  invoices    lineitem x orders x customer x nation x part as raw retail invoices
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.classify import code_override
from tallyspark.sources.tables import tables


@dataclass(frozen=True)
class Params:
    """Business parameters of the pipelines (the reference's one-row parameter tables)."""

    fact_from: date = date(1997, 10, 1)
    fact_to: date = date(1997, 10, 31)
    plan_from: date = date(1996, 10, 1)
    plan_to: date = date(1996, 10, 31)
    # Office id -> city label overrides (one shared table everywhere).
    city_overrides: tuple = (
        ((0, 5, 10), "Tolyatti"),
        ((1, 6), "Tyumen"),
        ((2, 7, 12), "Surgut"),
        ((3,), "Ufa"),
    )
    inactive_offices: tuple = (24,)
    # Product codes in scope, merged codes, the excluded product.
    products: tuple = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    merged_products: tuple = ("4-NOT SPECIFIED", "5-LOW")
    merged_label: str = "4-5-LOW"
    excluded_product: str = "3-MEDIUM"
    # Cross-sell period and report month.
    cross_from: date = date(1998, 1, 1)
    #: distinct items that a composition signature lists (None: all)
    signature_items: int | None = None
    cross_to: date = date(1998, 5, 31)
    report_from: date = date(1998, 5, 1)
    report_to: date = date(1998, 5, 31)
    # Insurance product groups for the cross-sell matrix.
    anchor_type: str = "STANDARD"
    kasko_types: tuple = ("LARGE",)
    ifl_types: tuple = ("SMALL", "MEDIUM")


DEFAULT = Params()


def offices(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Active offices with their city label: override map first, else the region name."""
    return t.memo(("offices", p), lambda: _offices(t, p))


def _offices(t: tables, p: Params) -> DataFrame:
    office = t.nation.filter(~F.col("n_nationkey").isin(list(p.inactive_offices))).select(
        F.col("n_nationkey").alias("office_id"), F.col("n_regionkey").alias("region_id")
    )
    region = t.region.select(F.col("r_regionkey").alias("region_id"), F.col("r_name"))
    joined = office.join(region, "region_id", "left")
    return joined.select(
        "office_id",
        code_override(F.col("office_id"), p.city_overrides, F.col("r_name")).alias("city"),
    )


def contracts(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Loan contracts: one row per order, with client, product, brand and city."""
    return t.memo(("contracts", p), lambda: _contracts(t, p))


def _contracts(t: tables, p: Params) -> DataFrame:
    o = t.orders.select(
        F.col("o_orderkey").alias("contract_id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").cast("date").alias("issue_dt"),
        F.col("o_totalprice").alias("loan_amt"),
        F.col("o_orderpriority").alias("product_raw"),
        F.col("o_orderstatus").alias("model"),
    )
    c = t.customer.select(
        F.col("c_custkey").alias("client_id"),
        F.col("c_nationkey").alias("office_id"),
        F.col("c_mktsegment").alias("brand"),
        # sub-product of the contract, present only while active (acctbal >= 0)
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("sub_product_nm"),
    )
    off = offices(t, p)
    df = o.join(c, "client_id", "inner").join(off, "office_id", "left")
    return df.select(
        "contract_id", "client_id", "issue_dt", "loan_amt", "product_raw",
        F.when(F.col("product_raw").isin(list(p.merged_products)), F.lit(p.merged_label))
        .otherwise(F.col("product_raw")).alias("product"),
        "brand", "model",
        F.when(F.col("model") == "F", F.lit("USED")).otherwise(F.lit("NEW")).alias("owner_type"),
        "sub_product_nm", "office_id", "city",
    )


def insurance(t: tables) -> DataFrame:
    """Insurance policies attached to loan agreements (history rows)."""
    li = t.lineitem
    return li.select(
        F.col("l_orderkey").alias("agreement_id"),
        F.col("l_linenumber").alias("risk_type"),
        F.col("l_suppkey").alias("insurer_id"),
        F.col("l_shipdate").cast("date").alias("open_dt"),
        F.col("l_partkey").alias("policy_id"),
        F.col("l_extendedprice").alias("payment_amt"),
        F.col("l_returnflag").alias("payment_desc"),
        F.col("l_linestatus").alias("status"),
    )


def policies(t: tables) -> DataFrame:
    """Client insurance contracts (con_id, type, payment, start and end dates)."""
    return t.memo("policies", lambda: _policies(t))


def _policies(t: tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    pt = t.part.select("p_partkey", "p_type")
    df = li.join(o, li.l_orderkey == o.o_orderkey, "inner").join(pt, li.l_partkey == pt.p_partkey, "inner")
    return df.select(
        F.col("o_custkey").alias("rgs_id"),
        F.col("l_orderkey").alias("con_id"),
        F.col("p_type").alias("ins_type"),
        F.col("l_extendedprice").alias("ins_pay"),
        F.col("o_orderdate").cast("date").alias("bgn_dt"),
        F.col("l_shipdate").cast("date").alias("end_dt"),
    )


def invoice_date_text(ts_col) -> F.Column:
    """Invoice timestamps as text: 4-digit years before 1998, 2-digit years after."""
    return F.when(F.year(ts_col) < 1998, F.date_format(ts_col, "M/d/yyyy H:mm")).otherwise(
        F.date_format(ts_col, "M/d/yy H:mm")
    )


def raw_invoices(t: tables) -> DataFrame:
    """Raw retail invoice lines with the reference's raw contract types."""
    return t.memo("raw_invoices", lambda: _raw_invoices(t))


def _raw_invoices(t: tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    pt = t.part.select("p_partkey", "p_name", "p_retailprice")
    # orders meet their customers first: the line items are then shuffled once, not again by customer
    heads = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
             .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    df = li.join(heads, li.l_orderkey == heads.o_orderkey).join(pt, F.col("l_partkey") == F.col("p_partkey"))
    return df.select(
        F.col("o_orderkey").cast("string").alias("InvoiceNo"),
        F.col("p_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        invoice_date_text(F.col("o_orderdate")).alias("InvoiceDate"),
        F.col("p_retailprice").alias("UnitPrice"),
        F.col("o_custkey").cast("double").alias("CustomerID"),
        F.col("n_name").alias("Country"),
    )


def country_reference(t: tables) -> DataFrame:
    """Country reference table (see ``_country_reference``)."""
    return t.memo("country", lambda: _country_reference(t))


def _country_reference(t: tables) -> DataFrame:
    """Country reference table (id, iso, name, nicename, iso3, numcode, phonecode).

    Built by rule from ``nation`` for the fixtures: nations of region 4 are
    not listed, so they exercise the NULL-iso path of the left join.
    The iso code of nation k is 'N' followed by the k-th capital letter, so
    nation 0 gets the code 'NA', which must stay text.
    """
    n = t.nation.filter(F.col("n_regionkey") != 4)
    return n.select(
        (F.col("n_nationkey") + 1).cast("int").alias("id"),
        F.concat(F.lit("N"), F.expr("char(65 + n_nationkey)")).alias("iso"),
        F.upper(F.col("n_name")).alias("name"),
        F.col("n_name").alias("nicename"),
        F.concat(F.lit("NX"), F.expr("char(65 + n_nationkey)")).alias("iso3"),
        (F.col("n_nationkey") * 4 + 4).cast("int").alias("numcode"),
        (F.col("n_nationkey") + 200).cast("int").alias("phonecode"),
    )
