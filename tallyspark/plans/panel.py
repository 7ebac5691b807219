"""Plan-versus-fact city panel (M9-M12) and contract features.

Stage graph (one lazy plan per output; persist the contract panel as a table
when several outputs read it):
  contracts x offices -> contract panel (conditional-MAX pivot of current insurance)
  contract panel -> penetration per city (one groupBy, 24 filtered aggregates)
  loan tranches -> weighted rates per city (one groupBy)
  plan long table -> plan totals per city (one groupBy with filtered sums)
  fact contracts -> fact splits per city (one groupBy with filtered counts)
  all of the above (each one row per city) -> report: left joins on the city

Scale notes: the reference scans contracts + office + region once per
subquery (8 times); here every per-city input is ONE partially aggregated
pass, and the final joins are between per-city tables whose size is bounded by
the number of cities (AQE broadcasts them, or joins them in place because the
aggregates are already partitioned by the city).  Dimension joins use
Spark's own size checks.  The large joins are orders to customers and the
insurance lines (lineitem) to the period's contracts; the period filter is
pushed into the orders scan first, so AQE can broadcast the filtered contracts
when the period is small and keeps a sort-merge join otherwise.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import last_week_end
from tallyspark.functions.numeric import MONEY
from tallyspark.functions.text import fold_homoglyphs, fold_literal, like_any
from tallyspark.operators.classify import first_match, membership_label, merge_codes, pair_flag, value_map
from tallyspark.operators.history import OPEN_END, build_history, current_version, latest_row
from tallyspark.operators.joins import effective_dated_lookup, resolve_effective_rules, role_flags
from tallyspark.operators.measures import (
    Metric,
    count_where,
    null_when_key_null,
    nullif_zero,
    penetration,
)
from tallyspark.operators.pivoting import conditional_max_pivot
from tallyspark.sources import adapters as ad
from tallyspark.sources.adapters import DEFAULT, Params
from tallyspark.sources.tables import tables

# Insurance risk types of the panel (type code -> column prefix)
# and the attributes pivoted for each type (column -> suffix).
RISK_TYPES = {1: "comp", 2: "life", 3: "other", 4: "ramk", 5: "dkasko", 6: "avl"}
RISK_ATTRS = {
    "insurer_id": "insurant",
    "open_dt": "open_dt",
    "policy_id": "contract_id",
    "payment_amt": "payment",
    "payment_desc": "pay_desc",
}

# Dated rate add-ons (from, to, add-on percent); the name rule
# (+6.70 for return flag 'R') is checked first.
RATE_NAME_RULE_ADDON = "6.70"
RATE_WINDOWS = [
    ("1995-01-01", "1995-06-30", "9.33"),
    ("1995-07-01", "1995-12-31", "8.33"),
    ("1996-01-01", "1996-06-30", "7.67"),
    ("1996-07-01", "1996-12-31", "7.33"),
    ("1997-01-01", "1997-06-30", "7.00"),
    ("1997-07-01", "1997-12-31", "6.67"),
    ("1998-01-01", "1998-06-30", "6.50"),
    ("1998-07-01", "1998-12-31", "6.17"),
    ("2000-01-01", "2001-12-31", "6.70"),
]

# Programme brands (FP) and the combined brand+model code.
FP_BRANDS = ["AUTOMOBILE", "MACHINERY"]
FP_COMBINED = "FURNITUREO"
PRIVATE_SUB_PRODUCT = "HOUSEHOLD"
METRIC_PCS = "issues_pcs"
METRIC_KRUB = "issues_krub"
# Plan product codes per report line.
NEW_CAR_PRODUCTS = ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED"]
FP_PLAN_PRODUCT = "1-URGENT"
ASP_PLAN_PRODUCT = "2-HIGH"


def _in_period(col, lo, hi):
    return F.col(col).between(F.lit(lo), F.lit(hi))


def fact_contracts(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Contracts of the fact period with a product in scope."""
    c = ad.contracts(t, p)
    return c.filter(_in_period("issue_dt", p.fact_from, p.fact_to) & F.col("product_raw").isin(list(p.products)))


# --- q01 -----------------------------------------------------------------------

def city_counts(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q01: contracts and loan sum per city label."""
    fc = fact_contracts(t, p)
    return fc.groupBy("city").agg(
        F.count("contract_id").cast("bigint").alias("contracts"),
        F.sum(F.col("loan_amt").cast(MONEY)).cast("double").alias("loan_sum"),
    )


# --- q02 (M9) ----------------------------------------------------------------------

def contract_panel(t: tables, p: Params = DEFAULT, latest: bool = False) -> DataFrame:
    """One row per fact contract with six insurance groups x five attributes.

    By default each attribute is an independent MAX over the group's current
    policies (so one row may mix policies, as the reference defines it);
    ``latest=True`` first keeps one policy per (agreement, risk type) -- the
    latest by open date, ties by policy id, insurer, payment, text -- so every
    group's attributes come from the same policy.
    """
    fc = fact_contracts(t, p).select("city", "contract_id", "issue_dt", "loan_amt", "product")
    current = ad.insurance(t).filter(F.col("status") == "O")
    mine = current.join(fc.select(F.col("contract_id").alias("agreement_id")), "agreement_id", "left_semi")
    if latest:
        mine = latest_row(mine.select("agreement_id", "risk_type", *RISK_ATTRS), ["agreement_id", "risk_type"],
                          ["open_dt", "policy_id", "insurer_id", "payment_amt", "payment_desc"])
    piv = conditional_max_pivot(mine, ["agreement_id"], "risk_type", RISK_TYPES, RISK_ATTRS)
    out = fc.join(piv, fc.contract_id == piv.agreement_id, "left").drop("agreement_id")
    return out


# --- q03 -----------------------------------------------------------------------------

def programme_rules(t: tables) -> DataFrame:
    """Q03: programme labels (first-match rules) and the nested OR flag, counted per product."""
    li = t.lineitem.select("l_orderkey", "l_partkey")
    pt = t.part.select("p_partkey", "p_name", "p_type")
    o = t.orders.select("o_orderkey", "o_orderpriority")
    df = li.join(pt, li.l_partkey == pt.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    name = F.upper(F.col("p_name"))
    folded = fold_homoglyphs(F.col("p_name"))
    prod = F.col("o_orderpriority")
    rules = [
        (name.contains("RING") & (prod == "1-URGENT"), "Ring urgent"),
        (name.contains("RING"), "Ring"),
        (name.contains("GEAR") & ~prod.isin("3-MEDIUM"), "Gear"),
        # pattern typed in Cyrillic look-alikes; folded on both sides
        (folded.contains(fold_literal("НОТ")), "Hot"),
        (name.contains("WIDGET") & (F.col("p_type") == "PROMO"), "Widget promo"),
        (name.contains("BOLT"), "Bolt"),
    ]
    programme = first_match(rules, "Other")
    flag = F.when(
        F.col("p_name").isNotNull(),
        F.when(folded.contains("K") | folded.contains("A") | F.upper(F.col("p_type")).contains("PROMO"), 1).otherwise(0),
    ).otherwise(0)
    df = df.select(programme.alias("programme"), prod.alias("product_raw"), flag.alias("flag"))
    return df.groupBy("programme", "product_raw").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.sum("flag").cast("bigint").alias("flag_rows")
    )


# --- q03d (C1, C6, M13): the ladder in full ----------------------------------------------

#: Letters that every fifth part name is typed with: the Cyrillic look-alikes of these Latin capitals.
TYPED_LATIN, TYPED_CYRILLIC = "TOEPCXHKMAB", "ТОЕРСХНКМАВ"


def ladder_rules(name: Column, kind: Column, product: Column, status: Column) -> list[tuple[Column, str]]:
    """Nineteen first-match rules on folded names: one pattern, pattern and product, pattern but not a product,
    several patterns with a class, pattern and status."""
    def has(*words: str) -> Column:
        out = name.contains(fold_literal(words[0]))
        for w in words[1:]:
            out = out & name.contains(fold_literal(w))
        return out

    return [
        (has("small ring") & (product == "1-URGENT"), "Small ring urgent"),
        (has("ring") & (product == "1-URGENT"), "Ring urgent"),
        (has("red ring"), "Red ring"),
        (has("old ring"), "Old ring"),
        (has("ring") & ~product.isin("3-MEDIUM"), "Ring"),
        (has("ъ"), "Hard sign"),
        (has("hot gear"), "Hot gear"),
        (has("gear"), "Gear"),
        (has("cold", "plate"), "Cold plate"),
        (has("new plate"), "New plate"),
        (has("blue", "rod"), "Blue rod"),
        (has("large rod"), "Large rod"),
        (has("anvil"), "Anvil"),
        (has("widget", "new") & (kind == "PROMO") & ~product.isin("3-MEDIUM"), "Widget special"),
        (has("widget", "old") & (kind == "PROMO") & ~product.isin("3-MEDIUM"), "Widget special"),
        (has("widget"), "Widget"),
        (has("gizmo") & (kind == "ECONOMY"), "Gizmo economy"),
        (has("bolt", "red"), "Red bolt"),
        (has("bolt") & (status == "F"), "Bolt closed"),
    ]


def rule_ladder(t: tables) -> DataFrame:
    """Q03d: line items by programme of the full ladder; names typed in either alphabet meet the same rules."""
    typed = F.when(F.col("p_partkey") % 5 == 0, F.translate(F.upper("p_name"), TYPED_LATIN, TYPED_CYRILLIC)).otherwise(
        F.col("p_name"))
    pt = t.part.select("p_partkey", typed.alias("p_name"), "p_type")
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    df = t.lineitem.select("l_orderkey", "l_partkey").join(pt, F.col("l_partkey") == F.col("p_partkey")).join(
        o, F.col("l_orderkey") == F.col("o_orderkey"))
    product = merge_codes(F.col("o_orderpriority"), ["4-NOT SPECIFIED", "5-LOW"], "4-5-LOW")
    programme = first_match(ladder_rules(fold_homoglyphs(F.col("p_name")), F.col("p_type"), F.col("o_orderpriority"),
                                         F.col("o_orderstatus")), "Other")
    foreign = (F.col("p_partkey") % 5 == 0).cast("int")
    return df.select(programme.alias("programme"), product.alias("product"), foreign.alias("foreign")).groupBy(
        "programme", "product").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("foreign").alias("foreign_rows"))


# --- q04 -----------------------------------------------------------------------------

# Fixed values: (city, brand) pairs whose contracts count in the denominator.
PAIRS = [
    ("Tolyatti", "AUTOMOBILE"),
    ("Surgut", "BUILDING"),
    ("EUROPE", "FURNITURE"),
    ("ASIA", "HOUSEHOLD"),
    ("AMERICA", "MACHINERY"),
]


# Report "as of" date: contracts issued from the fact start up to the end of the
# last full week before it (the Saturday; offset 1 would give the Sunday).
AS_OF = "1998-01-15"


def flagged_contracts(t: tables, p: Params = DEFAULT, as_of: str = AS_OF) -> DataFrame:
    """Contracts of the report period with brand label, programme membership, origin and pair flag."""
    c = ad.contracts(t, p)
    c = c.filter(F.col("issue_dt").between(F.lit(p.fact_from), last_week_end(F.lit(as_of).cast("date"))))
    spark = c.sparkSession
    marka = F.when((F.col("brand") == "AUTOMOBILE") & (F.col("model") == "O"), F.lit("AUTOMOBILE O")).otherwise(F.col("brand"))
    c = c.select(
        "contract_id", "issue_dt", "city", "product_raw", "loan_amt", "brand", "model", "sub_product_nm",
        marka.alias("marka"),
        value_map(F.col("model"), {"F": "domestic", "O": "foreign"}, "unknown").alias("rus_no"),
    ).withColumn("fp_flag", membership_label(F.col("marka"), ["AUTOMOBILE O", "MACHINERY", "FURNITURE"], "FP", "nonFP"))
    pairs = spark.createDataFrame(PAIRS, "city string, brand string")
    return pair_flag(c, pairs, ["city", "brand"], "pair_flag", also=F.col("sub_product_nm") == PRIVATE_SUB_PRODUCT)


def conditional_premium() -> Column:
    return F.when(F.col("brand").like("%MOBILE%"), F.col("loan_amt").cast("decimal(23,2)"))


def membership_flags(t: tables, p: Params = DEFAULT, as_of: str = AS_OF) -> DataFrame:
    """Q04: contracts and conditional premium per brand label, programme membership, origin and pair flag."""
    c = flagged_contracts(t, p, as_of)
    premium = conditional_premium()
    return c.groupBy("city", "marka", "fp_flag", "rus_no", "pair_flag").agg(
        F.count(F.lit(1)).cast("bigint").alias("contracts"),
        F.sum(premium).cast("double").alias("premium_sum"),
    )


# --- q05 (M10) ----------------------------------------------------------------------

def penetration_metrics(p: Params = DEFAULT) -> list[Metric]:
    """The six penetration metrics, each with its own population."""
    not_excl = F.col("product") != F.lit(p.excluded_product)
    return [
        Metric("vkasko", F.col("comp_contract_id").isNotNull() & (F.col("comp_pay_desc") == "N"), not_excl),
        Metric("mkasko", F.col("comp_contract_id").isNotNull() & F.col("comp_pay_desc").isin("A", "R")),
        Metric("sj", F.col("life_contract_id").isNotNull()),
        Metric("dkasko", F.col("dkasko_contract_id").isNotNull(), not_excl),
        Metric("ramk", F.col("ramk_contract_id").isNotNull() & (F.col("ramk_insurant") < 50)),
        Metric("avl", F.col("avl_contract_id").isNotNull()),
    ]


def penetration_table(panel: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Q05: penetration shares per city (NULL for a NULL city, which never matches)."""
    pen = penetration(panel.withColumnRenamed("city", "mac"), "mac", penetration_metrics(p), "loan_amt")
    return null_when_key_null(pen, "mac", [c for c in pen.columns if c != "mac"])


# --- q06 (M11) ----------------------------------------------------------------------

def rate_rules(spark) -> DataFrame:
    """The dated rate windows as a rule table; list order is the priority."""
    rows = [(i, date.fromisoformat(lo), date.fromisoformat(hi), Decimal(a)) for i, (lo, hi, a) in enumerate(RATE_WINDOWS)]
    return spark.createDataFrame(rows, "priority int, valid_from date, valid_to date, addon decimal(23,2)")


def rate_addon(eligible, ret_flag, window_addon):
    """Name rule first, then the dated window's add-on, else 0 (all only for eligible rows)."""
    zero = F.lit(Decimal("0.00")).cast("decimal(23,2)")
    return first_match([
        (eligible & (ret_flag == "R"), F.lit(Decimal(RATE_NAME_RULE_ADDON)).cast("decimal(23,2)")),
        (eligible, F.coalesce(window_addon, zero)),
    ], zero).cast("decimal(23,2)")


def weighted_rates(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q06: loan-weighted rate (with add-ons), term and down payment per city."""
    fc = fact_contracts(t, p).select("contract_id", "product_raw", "city")
    li = t.lineitem.select("l_orderkey", "l_discount", "l_tax", "l_quantity", "l_extendedprice",
                           "l_linestatus", "l_returnflag", "l_shipdate")
    df = li.join(fc, li.l_orderkey == fc.contract_id).withColumn("ship_dt", F.col("l_shipdate").cast("date"))
    intervals = resolve_effective_rules(rate_rules(df.sparkSession), "addon")
    df = effective_dated_lookup(df, "ship_dt", intervals, "addon", out="window_addon")
    eligible = (F.col("product_raw") != p.excluded_product) & (F.col("l_linestatus") == "F")
    # exact decimal arithmetic end to end: no double -> decimal rounding of products
    price = F.col("l_extendedprice").cast(MONEY)
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    rate = disc * 100
    stavka = (rate + rate_addon(eligible, F.col("l_returnflag"), F.col("window_addon"))).alias("stavka")
    loan = price.alias("loan")
    vc = (price * (1 + tax)).alias("vc")
    cl = (price * (1 - disc)).alias("cl")
    term = F.col("l_quantity").cast("int").alias("term")
    rows = df.select(F.col("city").alias("mac"), stavka, loan, vc, cl, term)
    g = rows.groupBy("mac").agg(
        F.sum(F.col("stavka") * F.col("loan")).alias("s_rate"),
        F.sum(F.col("term") * F.col("loan")).alias("s_term"),
        F.sum(F.col("vc") - F.col("cl")).alias("s_pv"),
        F.sum("loan").alias("s_loan"),
        F.sum("vc").alias("s_vc"),
    )
    d = lambda c: F.col(c).cast("double")
    return g.select(
        "mac",
        d("s_rate").alias("sum_stavkagp"),
        F.round(F.try_divide(d("s_rate"), d("s_loan")), 6).alias("sv_stavkagp"),
        F.round(F.try_divide(d("s_term"), d("s_loan")), 6).alias("sv_srokkred"),
        F.round(F.try_divide(d("s_pv"), d("s_vc")), 6).alias("sv_pv"),
        d("s_vc").alias("sv_veh_cost"),
    )


# --- plan tables (A10) ---------------------------------------------------------------

def plan_long(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Long plan table (mac, metric_name, product_code, date_sys, value_amt), all months."""
    c = ad.contracts(t, p)
    thousand = (F.col("loan_amt").cast(MONEY) * F.lit(Decimal("0.001"))).cast("decimal(23,5)")
    rows = F.explode(F.array(
        F.struct(F.lit(METRIC_PCS).alias("metric_name"), F.lit(1).cast("decimal(23,5)").alias("value_amt")),
        F.struct(F.lit(METRIC_KRUB).alias("metric_name"), thousand.alias("value_amt")),
    )).alias("m")
    return c.select(
        F.col("city").alias("mac"), F.col("product_raw").alias("product_code"), F.col("issue_dt").alias("date_sys"), rows
    ).select("mac", "m.metric_name", "product_code", "date_sys", "m.value_amt")


def plan_fp(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Sub-programme plan (mac, date_sys, value_cnt)."""
    c = ad.contracts(t, p).filter(F.col("product_raw") == FP_PLAN_PRODUCT)
    return c.select(F.col("city").alias("mac"), F.col("issue_dt").alias("date_sys"), F.lit(1).alias("value_cnt"))


def plan_totals(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q07: plan count and plan sum (thousands x 1000) per city and product."""
    pl = plan_long(t, p).filter(_in_period("date_sys", p.plan_from, p.plan_to))
    pcs = F.col("metric_name") == METRIC_PCS
    krub = F.col("metric_name") == METRIC_KRUB
    return pl.groupBy("mac", "product_code").agg(
        F.sum(F.when(pcs, F.col("value_amt"))).cast("bigint").alias("plan_count"),
        (F.sum(F.when(krub, F.col("value_amt"))) * 1000).cast("double").alias("plan_sum"),
    )


def plan_by_city(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Every plan figure of the report per city in one pass (+ the sub-programme plan)."""
    pl = plan_long(t, p).filter(_in_period("date_sys", p.plan_from, p.plan_to))
    pcs = F.col("metric_name") == METRIC_PCS
    krub = F.col("metric_name") == METRIC_KRUB
    prod = F.col("product_code")
    g = pl.groupBy("mac").agg(
        F.sum(F.when(pcs, F.col("value_amt"))).cast("bigint").alias("total_count_plan"),
        (F.sum(F.when(krub, F.col("value_amt"))) * 1000).cast("double").alias("total_sum_plan"),
        F.sum(F.when(pcs & prod.isin(NEW_CAR_PRODUCTS), F.col("value_amt"))).cast("bigint").alias("plan_new"),
        F.sum(F.when(pcs & (prod == ASP_PLAN_PRODUCT), F.col("value_amt"))).cast("bigint").alias("asp_d_count_plan"),
        F.sum(F.when(pcs & (prod == p.excluded_product), F.col("value_amt"))).cast("bigint").alias("ab_count_plan"),
    )
    fp = (plan_fp(t, p).filter(_in_period("date_sys", p.plan_from, p.plan_to))
          .groupBy("mac").agg(F.sum("value_cnt").cast("bigint").alias("fp_count_plan")))
    out = g.join(fp, g.mac.eqNullSafe(fp.mac), "left").drop(fp.mac)
    out = out.withColumn("fp_count_plan", F.when(F.col("mac").isNotNull(), F.col("fp_count_plan")))
    return out.select(
        "mac", "total_count_plan", "total_sum_plan", "fp_count_plan",
        (F.col("plan_new") - F.col("fp_count_plan")).alias("nefp_count_plan"),
        "asp_d_count_plan", F.lit(0).cast("bigint").alias("c2c_count_plan"), "ab_count_plan",
    )


# --- q08 / q09 (A12) -------------------------------------------------------------------

def fact_splits(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Every fact count of the report per city in ONE scan of the period's contracts."""
    fc = fact_contracts(t, p)
    not_excl = F.col("product_raw") != p.excluded_product
    new = not_excl & (F.col("owner_type") == "NEW")
    used = not_excl & (F.col("owner_type") == "USED")
    bm = F.concat(F.col("brand"), F.col("model"))
    fp = new & like_any(bm, [b + "%" for b in FP_BRANDS] + [FP_COMBINED + "%"])
    nefp = new
    for b in FP_BRANDS:
        nefp = nefp & (F.col("brand") != b)
    nefp = nefp & (bm != FP_COMBINED)
    sub = F.upper(F.col("sub_product_nm"))
    private = "%" + PRIVATE_SUB_PRODUCT + "%"
    asp = used & ~sub.like(private)
    c2c = used & sub.like(private)
    ab = F.col("product_raw") == p.excluded_product
    g = fc.groupBy(F.col("city").alias("mac")).agg(
        F.count("contract_id").cast("bigint").alias("total_count_fact"),
        F.sum(F.col("loan_amt").cast(MONEY)).alias("__sum"), F.count("loan_amt").alias("__loans"),
        count_where(fp).alias("fp"), count_where(nefp).alias("nefp"), count_where(asp).alias("asp"),
        count_where(c2c).alias("c2c"), count_where(ab).alias("ab"),
    )
    known = F.col("mac").isNotNull()
    return g.select(
        "mac", "total_count_fact", F.col("__sum").cast("double").alias("total_sum_fact"),
        F.round(F.try_divide(F.col("__sum").cast("double"), F.col("__loans")), 6).alias("medium_check"),
        F.when(known, nullif_zero(F.col("fp"))).alias("fp_count_fact"),
        F.when(known, nullif_zero(F.col("nefp"))).alias("nefp_count_fact"),
        F.when(known, nullif_zero(F.col("asp"))).alias("asp_d_count_fact"),
        F.when(known, F.col("c2c")).otherwise(F.lit(0)).cast("bigint").alias("c2c_count_fact"),
        F.when(known, F.col("ab")).otherwise(F.lit(0)).cast("bigint").alias("ab_count_fact"),
    )


# --- q10 / q11 (M13) ---------------------------------------------------------------------

LATEST_ORDER = ["open_dt", "risk_type", "policy_id", "insurer_id", "payment_amt"]


def latest_policy(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q10: every contract with its latest policy of the selected risk types."""
    hist = ad.insurance(t).filter((F.col("status") == "O") & F.col("risk_type").isin(4, 7))
    latest = latest_row(hist.select("agreement_id", *LATEST_ORDER), "agreement_id", LATEST_ORDER)
    c = t.orders.select(F.col("o_orderkey").alias("contract_id"), F.col("o_orderdate").cast("date").alias("issue_dt"))
    out = c.join(latest, c.contract_id == latest.agreement_id, "left")
    return out.select("contract_id", "issue_dt", *[F.col(x).alias(f"latest_{x}") for x in LATEST_ORDER])


def client_status_history(t: tables) -> DataFrame:
    """The history of each client's order status and priority, built from its orders as change rows."""
    changes = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")
    hist = build_history(changes, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    open_end = F.col("effective_to") == F.lit(OPEN_END).cast("timestamp_ntz")
    return hist.select(F.col("o_custkey").alias("client_id"), F.col("o_orderstatus").alias("status"),
                       F.col("o_orderpriority").alias("priority"), F.col("effective_from").cast("date").alias("valid_from"),
                       F.when(~open_end, F.col("effective_to")).cast("date").alias("valid_to"), open_end.alias("is_current"))


# Cancellation role code per flag.
ROLE_FLAGS = {"flg_vk_rastor": 1, "flg_mk_rastor": 2, "flg_sj_rastor": 3, "flg_dk_rastor": 4}


def cancellation_flags(t: tables) -> DataFrame:
    """Q11: four cancellation-role presence flags per contract."""
    canc = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    c = t.orders.select(F.col("o_orderkey").alias("contract_id"))
    return role_flags(c, "contract_id", canc, "l_orderkey", "l_linenumber", ROLE_FLAGS)


# Risk types whose latest current policy a contract carries, by name of the set.
RISK_SETS = {"vehicle": [1], "motor": [2], "life": [3], "extended": [5], "gap": [6], "other": [4, 7]}


def contract_features(t: tables, p: Params = DEFAULT, as_of: str = AS_OF) -> DataFrame:
    """One row per contract with label, flags, premium, cancellation roles and latest policies.

    The insurance history is read once: filtered maxima of one partially
    aggregated ``groupBy`` give the latest current policy of every risk set and
    the cancellation roles together.
    """
    rules = [
        (F.col("brand").contains("MOBILE") & (F.col("product_raw") == "1-URGENT"), "urgent car"),
        (F.col("brand").contains("MOBILE"), "car"),
        (F.col("sub_product_nm") == PRIVATE_SUB_PRODUCT, "private"),
        (F.col("product_raw").isin("4-NOT SPECIFIED", "5-LOW"), "low"),
    ]
    c = flagged_contracts(t, p, as_of).select(
        "contract_id", "issue_dt", "city", first_match(rules, "other").alias("programme"), "marka", "fp_flag", "rus_no",
        "pair_flag", conditional_premium().cast("double").alias("premium"))
    open_end = F.lit(OPEN_END).cast("timestamp")
    hist = ad.insurance(t).withColumns({
        "effective_to": F.when(F.col("status") == "O", open_end).otherwise(F.col("open_dt").cast("timestamp")),
        "deleted_flg": F.lit("0")})
    current = current_version(hist.withColumn("current", F.lit(True)))
    ended = hist.filter((F.col("status") == "F") & (F.col("payment_desc") == "R")).withColumn("current", F.lit(False))
    latest = F.struct("open_dt", "policy_id", "insurer_id", "payment_amt")
    aggs = [F.max(F.when(F.col("current") & F.col("risk_type").isin(types), latest)).alias(name)
            for name, types in RISK_SETS.items()]
    aggs += [F.max(F.when(~F.col("current") & (F.col("risk_type") == role), 1)).alias(name) for name, role in ROLE_FLAGS.items()]
    one = current.unionByName(ended).groupBy("agreement_id").agg(*aggs)
    out = c.join(one, c.contract_id == one.agreement_id, "left")
    return out.select(
        *c.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in ROLE_FLAGS],
        *[F.col(f"{n}.{x}").alias(f"{n}_{x}") for n in RISK_SETS for x in ("open_dt", "policy_id", "payment_amt")])


# --- q12 ----------------------------------------------------------------------------------

def residual_plan(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Q12: new-car plan minus the sub-programme plan, and the zero C2C plan, per city."""
    return plan_by_city(t, p).select("mac", "nefp_count_plan", "c2c_count_plan")


# --- q13 (M12) -----------------------------------------------------------------------------

REPORT_COLUMNS = [
    "date_from", "date_to", "mak",
    "total_count_plan", "total_count_fact", "ispol_plana_count",
    "total_sum_plan", "total_sum_fact", "ispol_plana_sum", "medium_check",
    "fp_count_plan", "fp_count_fact", "ispol_plana_fp",
    "nefp_count_plan", "nefp_count_fact", "ispol_plana_nefp",
    "asp_d_count_plan", "asp_d_count_fact", "ispol_plana_asp_d",
    "c2c_count_plan", "c2c_count_fact", "ispol_plana_c2c",
    "vkasko_penet_sht", "vkasko_penet_rub", "mkasko_penet_sht", "mkasko_penet_rub",
    "sj_penet_sht", "sj_penet_rub", "dkasko_penet_sht", "dkasko_penet_rub",
    "ramk_penet_sht", "ramk_penet_rub", "avl_penet_sht", "avl_penet_rub",
    "sv_stavkagp", "sv_srokkred", "ab_count_plan", "ab_count_fact", "sv_pv", "sv_veh_cost",
]


def plan_vs_fact(t: tables, p: Params = DEFAULT, panel: DataFrame | None = None) -> DataFrame:
    """Q13: the plan-versus-fact city report (40 columns)."""
    fact = fact_splits(t, p)
    plan = plan_by_city(t, p)
    pen = penetration_table(panel if panel is not None else contract_panel(t, p), p)
    rates = weighted_rates(t, p).drop("sum_stavkagp")

    def attach(left, right):
        return left.join(right, left.mac == right.mac, "left").drop(right.mac)

    rep = attach(attach(attach(fact, plan), pen), rates)
    r6 = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    c2c_ratio = F.when(F.col("c2c_count_plan") == 0, F.lit(0.0)).otherwise(
        F.coalesce(r6("c2c_count_fact", "c2c_count_plan"), F.lit(0.0)))
    rep = rep.select(
        "*",
        F.lit(p.fact_from.isoformat()).alias("date_from"), F.lit(p.fact_to.isoformat()).alias("date_to"),
        F.col("mac").alias("mak"),
        r6("total_count_fact", "total_count_plan").alias("ispol_plana_count"),
        r6("total_sum_fact", "total_sum_plan").alias("ispol_plana_sum"),
        r6("fp_count_fact", "fp_count_plan").alias("ispol_plana_fp"),
        r6("nefp_count_fact", "nefp_count_plan").alias("ispol_plana_nefp"),
        r6("asp_d_count_fact", "asp_d_count_plan").alias("ispol_plana_asp_d"),
        c2c_ratio.alias("ispol_plana_c2c"),
    )
    return rep.select(*REPORT_COLUMNS)


# --- q09b: the NOT LIKE split on the part name --------------------------------------------

# The part-name marker of private (C2C) deals and the active-part rule.
PRIVATE_PART_MARK = "GEAR"
ACTIVE_PART_MAX_SIZE = 45


def fact_part_like_split(t: tables, p: Params = DEFAULT) -> DataFrame:
    """Used-car facts per city split by ``NOT LIKE`` / ``LIKE`` on the sub-product's part name.

    A contract's sub-product is its smallest part key (one deterministic
    aggregate per contract, computed only for the period's contracts); the part
    dimension is joined with its "active" rule inside the join, so inactive
    parts leave the name NULL and the NOT LIKE drops those contracts.
    """
    fc = fact_contracts(t, p)
    keys = fc.select(F.col("contract_id").alias("l_orderkey"))
    sub = (t.lineitem.select("l_orderkey", "l_partkey").join(keys, "l_orderkey", "left_semi")
           .groupBy("l_orderkey").agg(F.min("l_partkey").alias("sub_id")))
    active_parts = t.part.filter(F.col("p_size") <= ACTIVE_PART_MAX_SIZE).select(
        F.col("p_partkey").alias("sub_id"), F.col("p_name").alias("sub_nm"))
    rows = (fc.join(sub, fc.contract_id == sub.l_orderkey, "left")
            .join(active_parts, "sub_id", "left"))
    used = (F.col("product_raw") != p.excluded_product) & (F.col("owner_type") == "USED")
    name = F.upper(F.col("sub_nm"))
    mark = f"%{PRIVATE_PART_MARK}%"
    g = rows.groupBy(F.col("city").alias("mac")).agg(
        count_where(used & ~name.like(mark)).alias("asp"), count_where(used & name.like(mark)).alias("c2c"))
    known = F.col("mac").isNotNull()
    return g.select(
        "mac",
        F.when(known, nullif_zero(F.col("asp"))).alias("asp_d_count_fact"),
        F.when(known, F.col("c2c")).otherwise(F.lit(0)).cast("bigint").alias("c2c_count_fact"),
    )
