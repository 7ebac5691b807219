"""Retail star schema (M1-M7): raw invoices -> dims -> fact -> reports.

Scale notes
-----------
* The three dimensions are derived from the raw table itself, so the fact's
  inner joins to them act as filters (non-null customer, stock code and date,
  price > 0).  ``fct_invoices(mode="derived")`` applies exactly those filters
  with no join (zero shuffles for the fact); ``mode="join"`` performs the
  literal joins and is kept for dimensions that come from elsewhere.  A unit
  test checks both modes return the same rows.
* Reports pre-aggregate the fact per dimension key (map-side combined) before
  joining the dimension, so only one row per key crosses the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import parse_invoice_datetime, weekday_sun1
from tallyspark.functions.keys import key_bytes, surrogate_key
from tallyspark.functions.numeric import MONEY

CUSTOMER_KEY = ["CustomerID", "Country"]
PRODUCT_KEY = ["StockCode", "Description", "UnitPrice"]


def dim_customer(raw: DataFrame, country: DataFrame) -> DataFrame:
    """Customer dimension: distinct hashed (customer, country) with the country's ISO code."""
    keys = raw.filter(F.col("CustomerID").isNotNull()).select(*CUSTOMER_KEY).distinct()
    base = keys.select(surrogate_key(keys, CUSTOMER_KEY).alias("customer_id"), F.col("Country").alias("country")).distinct()
    cm = country.select("nicename", "iso")
    return base.join(cm, base.country == cm.nicename, "left").select("customer_id", "country", "iso")


def dim_datetime(raw: DataFrame, strict_lengths: bool = False) -> DataFrame:
    """Datetime dimension: distinct invoice-date texts, parsed, with six calendar parts."""
    base = raw.filter(F.col("InvoiceDate").isNotNull()).select(F.col("InvoiceDate").alias("datetime_id")).distinct()
    dt = parse_invoice_datetime(F.col("datetime_id"), strict_lengths=strict_lengths)
    base = base.withColumn("datetime", dt)
    return base.select(
        "datetime_id", "datetime",
        F.year("datetime").alias("year"), F.month("datetime").alias("month"),
        F.dayofmonth("datetime").alias("day"), F.hour("datetime").alias("hour"),
        F.minute("datetime").alias("minute"), weekday_sun1(F.col("datetime")).alias("weekday"),
    )


def dim_product(raw: DataFrame) -> DataFrame:
    """Product dimension: distinct hashed (stock code, description, price), price > 0."""
    keys = raw.filter(F.col("StockCode").isNotNull() & (F.col("UnitPrice") > 0)).select(*PRODUCT_KEY).distinct()
    return keys.select(
        surrogate_key(keys, PRODUCT_KEY).alias("product_id"),
        F.col("StockCode").alias("stock_code"),
        F.col("Description").alias("description"),
        F.col("UnitPrice").alias("price"),
    ).distinct()


def _fact_base(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("Quantity") > 0)


def fct_invoices(raw: DataFrame, mode: str = "derived", dims: dict[str, DataFrame] | None = None,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Fact rows: quantity > 0, total = quantity * price, keyed to the three dimensions.

    ``carry`` keeps extra raw columns on the fact rows (derived mode only); the
    reports use it to read dimension attributes without re-deriving a dimension.
    """
    base = _fact_base(raw)
    cols = [*[F.col(c) for c in carry],
        F.col("InvoiceNo").alias("invoice_id"),
        F.col("InvoiceDate").alias("datetime_id"),
        surrogate_key(raw, PRODUCT_KEY).alias("product_id"),
        surrogate_key(raw, CUSTOMER_KEY).alias("customer_id"),
        F.col("Quantity").alias("quantity"),
        (F.col("Quantity") * F.col("UnitPrice")).alias("total"),
    ]
    if mode == "derived":
        keep = (
            F.col("InvoiceDate").isNotNull()
            & F.col("StockCode").isNotNull() & (F.col("UnitPrice") > 0)
            & F.col("CustomerID").isNotNull()
        )
        return base.filter(keep).select(*cols)
    if mode != "join":
        raise ValueError(mode)
    dims = dims or {}
    dt = dims.get("datetime", dim_datetime(raw)).select("datetime_id").repartition(F.xxhash64("datetime_id"))
    dp = dims.get("product", dim_product(raw)).select(key_bytes(F.col("product_id")).alias("product"))
    dc = dims["customer"].select(key_bytes(F.col("customer_id")).alias("customer"))
    # Rows cross the joins with keys of half the bytes, the customer's as its own columns until it is met.  The dates,
    # usually few, come last and are dealt again when distinct: their side is then known to be small before the fact's
    # rows would be shuffled for it.
    fi = base.select(
        F.col("InvoiceNo").alias("invoice_id"), F.col("InvoiceDate").alias("datetime_id"),
        key_bytes(surrogate_key(raw, PRODUCT_KEY)).alias("product"), *CUSTOMER_KEY,
        F.col("Quantity").alias("quantity"), (F.col("Quantity") * F.col("UnitPrice")).alias("total"))
    sold = fi.join(dp, "product")
    sold = sold.withColumn("customer", key_bytes(surrogate_key(raw, CUSTOMER_KEY))).drop(*CUSTOMER_KEY)
    text = lambda key: F.lower(F.hex(key))  # noqa: E731 - the fact's own keys are hexadecimal digits
    return sold.join(dc, "customer").join(dt, "datetime_id").select(
        "invoice_id", "datetime_id", text("product").alias("product_id"), text("customer").alias("customer_id"),
        "quantity", "total")


def report_customer_invoices(fct: DataFrame, dim_cust: DataFrame, top: int = 10) -> DataFrame:
    """Top countries by revenue (fact pre-aggregated per customer and invoice, then joined)."""
    per_key = fct.groupBy(key_bytes(F.col("customer_id")).alias("customer"), "invoice_id").agg(
        F.count("invoice_id").alias("n"), F.sum(F.col("total").cast(MONEY)).alias("rev"))
    return _countries(per_key.join(dim_cust.withColumn("customer", key_bytes(F.col("customer_id"))), "customer"), top)


def _countries(per_invoice: DataFrame, top: int) -> DataFrame:
    """The country report from sums by (country, iso, invoice, ...): an invoice counts once for a country."""
    once = per_invoice.groupBy("country", "iso", "invoice_id").agg(F.sum("n").alias("n"), F.sum("rev").alias("rev"))
    rep = once.groupBy("country", "iso").agg(
        F.sum("n").cast("bigint").alias("total_invoices"),  # invoice lines, as the reference counts them
        F.count("invoice_id").cast("bigint").alias("distinct_invoices"),
        F.sum("rev").cast("double").alias("total_revenue"),
    )
    return rep.orderBy(F.desc("total_revenue"), F.asc("country")).limit(top)


def report_product_invoices(fct: DataFrame, dim_prod: DataFrame, top: int = 10) -> DataFrame:
    """Top products by quantity sold (fact pre-aggregated per product, then joined)."""
    per_key = fct.groupBy("product_id").agg(F.sum("quantity").alias("q"))
    joined = per_key.join(dim_prod, "product_id")
    rep = joined.groupBy("product_id", "stock_code", "description").agg(
        F.sum("q").cast("bigint").alias("total_quantity_sold")
    )
    return rep.orderBy(F.desc("total_quantity_sold"), F.asc("product_id")).limit(top)


def report_year_invoices(fct: DataFrame, dim_dt: DataFrame) -> DataFrame:
    """Distinct invoices and revenue per year and month."""
    per_key = fct.groupBy("datetime_id", "invoice_id").agg(F.sum(F.col("total").cast(MONEY)).alias("rev"))
    joined = per_key.join(dim_dt.select("datetime_id", "year", "month"), "datetime_id")
    rep = joined.groupBy("year", "month").agg(
        F.countDistinct("invoice_id").cast("bigint").alias("num_invoices"),
        F.sum("rev").cast("double").alias("total_revenue"),
    )
    return rep.orderBy(F.asc_nulls_last("year"), F.asc_nulls_last("month"))


# --- reports in one pass over the raw layer ------------------------------------------------
# Each dimension row is a pure function of the raw columns its key is built
# from (customer: Country; product: StockCode, Description; datetime: the
# text itself), and every fact row's key exists in its dimension.  So
# "fact JOIN dimension" equals reading those attributes off the fact's own raw
# row: one pass over the raw join instead of two.  Tests check both forms agree.


def report_customer_invoices_1pass(raw: DataFrame, country: DataFrame, top: int = 10) -> DataFrame:
    rows = fct_invoices(raw, carry=("Country",))
    per_key = rows.groupBy(F.col("Country").alias("country"), "invoice_id").agg(
        F.count("invoice_id").alias("n"), F.sum(F.col("total").cast(MONEY)).alias("rev"))
    cm = country.select("nicename", "iso")
    return _countries(per_key.join(cm, per_key.country == cm.nicename, "left"), top)


def report_product_invoices_1pass(raw: DataFrame, top: int = 10) -> DataFrame:
    rows = fct_invoices(raw, carry=("StockCode", "Description"))
    rep = rows.groupBy("product_id", F.col("StockCode").alias("stock_code"),
                       F.col("Description").alias("description")).agg(
        F.sum("quantity").cast("bigint").alias("total_quantity_sold"))
    return rep.orderBy(F.desc("total_quantity_sold"), F.asc("product_id")).limit(top)


def report_year_invoices_1pass(raw: DataFrame) -> DataFrame:
    per_key = fct_invoices(raw).groupBy("datetime_id", "invoice_id").agg(
        F.sum(F.col("total").cast(MONEY)).alias("rev"))
    # the datetime text is parsed on the reduced rows, without a join
    dt = parse_invoice_datetime(F.col("datetime_id"))
    rows = per_key.select("invoice_id", "rev", F.year(dt).alias("year"), F.month(dt).alias("month"))
    rep = rows.groupBy("year", "month").agg(
        F.countDistinct("invoice_id").cast("bigint").alias("num_invoices"),
        F.sum("rev").cast("double").alias("total_revenue"),
    )
    return rep.orderBy(F.asc_nulls_last("year"), F.asc_nulls_last("month"))
