import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.functions.keys import key_bytes, surrogate_key
from tallyspark.plans import gates
from tallyspark.plans import retail_star as rs
from tallyspark.sources import adapters as ad
from tallyspark.sources import io as sio
from tallyspark.sources.release import write_observed
from tallyspark.sources.tables import TABLES, tables
from tallyspark.plans.catalogue import QUERIES
from tallyspark.session import materialize, scratch_dir


def _norm(v):
    import datetime as d
    import decimal
    import math
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(float(v))
    if isinstance(v, (d.date, d.datetime)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_small, duck, key):
    df = entry.queries()[key](spark, sf_small)
    rows = df.collect()
    sql = entry.oracle_sql().get(key)
    assert sql is not None, "every catalogue key has an oracle"
    types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    rel = duck.sql(sql)
    duck_types = dict(zip(rel.columns, [str(x) for x in rel.types]))
    assert {c: types.get(t, t) for c, t in df.dtypes} == duck_types
    cur = duck.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    a = sorted(tuple(_norm(r[c]) for c in order) for r in rows)
    b = sorted(tuple(_norm(dict(zip(cols, r))[c]) for c in order) for r in cur.fetchall())
    assert a == b


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "ispol_plana_count" in df.columns


def test_fact_derived_mode_equals_join_mode(spark, sf_small):
    t = tables(spark, sf_small)
    raw = ad.raw_invoices(t)
    dims = {"customer": rs.dim_customer(raw, ad.country_reference(t))}
    a = rs.fct_invoices(raw, "derived")
    b = rs.fct_invoices(raw, "join", dims)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_gate_pipeline_passes_with_stored_models(spark, sf_small):
    t = tables(spark, sf_small)
    res = gates.gate_results(ad.raw_invoices(t), ad.country_reference(t), store=materialize)
    assert res.filter("NOT passed AND table_name <> 'raw_invoices'").count() == 0
    assert res.filter("NOT passed").count() == 5  # every kind of check sees violations on the raw layer
    assert gates.enforce_all(ad.raw_invoices(t), ad.country_reference(t)).count() > 0


def test_csv_roundtrip_keeps_na_text(spark):
    df = spark.createDataFrame([("1", "NA", "desc", 2, "1/2/2011 3:04", 1.5, 10.0, "NA")],
                               "InvoiceNo string, StockCode string, Description string, Quantity int, "
                               "InvoiceDate string, UnitPrice double, CustomerID double, Country string")
    path = scratch_dir(spark, "csv_test")
    sio.write_csv(df, path)
    back = sio.read_csv_typed(spark, path).first()
    assert back.Country == "NA" and back.StockCode == "NA" and back.UnitPrice == 1.5


def test_copy_tables_audit(spark, sf_small):
    names = sio.discover_tables(spark, sf_small, ["nation", "region", "nope"])
    assert names == ["nation", "region"]
    audit = {r.table_name: r.rows_imported for r in
             sio.copy_tables(spark, sf_small, names, scratch_dir(spark, "copy_test")).collect()}
    assert audit == {"nation": 25, "region": 5}


def test_snapshot_scan_prunes_partitions(spark):
    from pyspark.sql import functions as F

    from tallyspark.sources.io import replace_table
    from tallyspark.sources.tables import scan_snapshot

    df = spark.range(100).select(F.col("id"), (F.lit(201800) + F.col("id") % 4 + 1).alias("yyyymm"))
    path = scratch_dir(spark, "snapshots")
    replace_table(df, path, partition_by=["yyyymm"])
    snap = scan_snapshot(spark.read.parquet(path), "yyyymm", 201802)
    plan = snap._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "201802" in plan
    assert snap.count() == 25


def test_materialize_round_trip(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    m = materialize(df, "mat_test")
    assert sorted(r.x for r in m.collect()) == list(range(10))
    assert "parquet" in m._jdf.queryExecution().executedPlan().toString().lower()


def test_discover_catalog_tables(spark):
    spark.range(3).createOrReplaceTempView("dim_product_src")
    assert sio.discover_catalog_tables(spark, ["missing_view", "dim_product_src"]) == ["dim_product_src"]


def test_pipeline_runs_store_every_stage(spark, sf_small):
    from tallyspark.plans import pipelines as pl

    t = tables(spark, sf_small)
    out = scratch_dir(spark, "pipelines")
    panel = pl.run_panel(t, out)
    assert panel["plan_vs_fact"].count() == entry.queries()["q13_plan_vs_fact"](spark, sf_small).count()
    assert panel["su_panel"].count() == entry.queries()["q02_contract_panel"](spark, sf_small).count()
    cross = pl.run_cross_sell(t, out)
    assert cross["cross_weekly"].exceptAll(
        entry.queries()["q20_composition_weekly"](spark, sf_small)).count() == 0
    retail = pl.run_retail(t, out)
    assert retail["gate_results"].filter("NOT passed").count() == 0
    assert retail["report_customer_invoices"].count() == 10
    prod = pl.run_product_etl(spark, sf_small, scratch_dir(spark, "stage"))
    assert prod["audit"].first().rows_imported == 200
    assert prod["prd_product"].exceptAll(entry.queries()["q32_product_snowflake"](spark, sf_small)).count() == 0


def test_one_pass_reports_equal_fact_dimension_joins(spark, sf_small):
    t = tables(spark, sf_small)
    raw, country = ad.raw_invoices(t), ad.country_reference(t)
    fct = rs.fct_invoices(raw)
    pairs = [
        (rs.report_customer_invoices_1pass(raw, country, 1000),
         rs.report_customer_invoices(fct, rs.dim_customer(raw, country), 1000)),
        (rs.report_product_invoices_1pass(raw, 100000), rs.report_product_invoices(fct, rs.dim_product(raw), 100000)),
        (rs.report_year_invoices_1pass(raw), rs.report_year_invoices(fct, rs.dim_datetime(raw))),
    ]
    for a, b in pairs:
        assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_gates_on_panel_outputs(spark, sf_small):
    """The quality gates applied to our own panel outputs (one row per city, sane measures)."""
    from pyspark.sql import functions as F

    from tallyspark.operators.quality import Check, QualityGate

    rep = entry.queries()["q13_plan_vs_fact"](spark, sf_small)
    pen = entry.queries()["q05_penetration"](spark, sf_small)
    gate = QualityGate({
        "plan_vs_fact": (rep, [
            Check("one row per city", "duplicate", "mak"),
            Check("fact counts positive", "min", "total_count_fact", fail_op="<=", threshold=0),
            Check("average check positive", "min", "medium_check", fail_op="<=", threshold=0),
        ]),
        "penetration": (pen, [
            Check("shares within 0..1", "failed_rows", predicate=(F.col("sj_penet_sht") < 0) | (F.col("sj_penet_sht") > 1)),
            Check("rub shares within 0..1", "invalid", "avl_penet_rub", valid_min=0, valid_max=1),
        ]),
    })
    assert gate.enforce().filter("NOT passed").count() == 0


def test_contract_panel_latest_policy_option(spark, sf_small):
    from pyspark.sql import functions as F

    from tallyspark.plans import panel as pn
    from tallyspark.sources.adapters import insurance

    t = tables(spark, sf_small)
    mixed = pn.contract_panel(t)
    one = pn.contract_panel(t, latest=True)
    assert one.count() == mixed.count()
    # with latest=True every group's attributes are one real policy row
    ins = insurance(t).filter(F.col("status") == "O").select(
        F.col("agreement_id").alias("contract_id"), F.col("policy_id").alias("comp_contract_id"),
        F.col("insurer_id").alias("comp_insurant"), F.col("payment_amt").alias("comp_payment"),
        F.col("risk_type"))
    rows = one.filter("comp_contract_id IS NOT NULL").select(
        "contract_id", "comp_contract_id", "comp_insurant", "comp_payment")
    real = ins.filter("risk_type = 1").drop("risk_type")
    assert rows.join(real, ["contract_id", "comp_contract_id", "comp_insurant", "comp_payment"],
                     "left_anti").count() == 0


def test_csv_permissive_keeps_malformed_rows(spark, tmp_path):
    path = f"file://{tmp_path}"
    with open(tmp_path / "part-0.csv", "w") as f:
        f.write("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n")
        f.write("1,A,x,abc,1/2/2011 3:04,2.5,,NA\n")
        f.write("2,B,y,3,1/2/2011 3:05,oops,17.0,Kenya\n")
    rows = {r.InvoiceNo: r for r in sio.read_csv_typed(spark, path).collect()}
    assert rows["1"].Quantity is None and rows["1"].CustomerID is None and rows["1"].Country == "NA"
    assert rows["2"].UnitPrice is None and rows["2"].Quantity == 3 and rows["2"].CustomerID == 17.0


def test_keys_as_bytes_are_equal_where_texts_are(spark):
    texts = [None, "", "0" * 32, "0" * 31 + "a", "0" * 31 + "A", "a" * 16, "\0" * 16, "0" * 32 + "\n", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "k string").select("k", key_bytes(F.col("k")).alias("b"))
    rows = df.collect()
    assert all((r.k is None) == (r.b is None) for r in rows)
    assert len({bytes(r.b) for r in rows if r.b is not None}) == len(texts) - 1
    assert len(next(r.b for r in rows if r.k == "0" * 32)) == 16


def test_joined_fact_keeps_repeats_of_dimensions_and_moves_short_keys(spark):
    raw = spark.createDataFrame(
        [("1", "a", "x", 2, "1/2/1997 3:04", 1.5, 7.0, "FR"), ("1", "b", None, 1, "1/2/1997 3:04", 2.0, 8.0, "DE"),
         ("2", "a", "x", 2, None, 1.5, 7.0, "FR"), ("2", None, "x", 3, "1/2/1997 3:05", 1.5, 7.0, None),
         ("3", "a", "x", 4, "1/2/1997 3:05", 0.0, None, "FR"), ("4", "a-x", "y", 5, "1/2/1997 3:05", 1.0, 7.0, "FR"),
         ("4", "a", "x-y", 5, "1/2/1997 3:05", 1.0, 7.0, "FR"), ("5", "a", "x", 0, "1/2/1997 3:05", 1.0, 7.0, "FR")],
        "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate string, UnitPrice double, "
        "CustomerID double, Country string")
    country = spark.createDataFrame([("FR", "F1"), ("FR", "F2")], "nicename string, iso string")
    dims = rs.dim_customer(raw, country)
    fact = rs.fct_invoices(raw, "join", {"customer": dims})
    fi = raw.filter("Quantity > 0").select(
        F.col("InvoiceNo").alias("invoice_id"), F.col("InvoiceDate").alias("datetime_id"),
        surrogate_key(raw, rs.PRODUCT_KEY).alias("product_id"), surrogate_key(raw, rs.CUSTOMER_KEY).alias("customer_id"),
        F.col("Quantity").alias("quantity"), (F.col("Quantity") * F.col("UnitPrice")).alias("total"))
    want = (fi.join(rs.dim_datetime(raw).select("datetime_id"), "datetime_id")
            .join(rs.dim_product(raw).select("product_id"), "product_id").join(dims.select("customer_id"), "customer_id"))
    rows = sorted(map(tuple, fact.collect()))
    assert rows == sorted(map(tuple, want.select(fact.columns).collect())) and len(rows) == 2 + 1 + 2 * 2 * 2
    joins = [c for c in fact._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in c]
    assert joins and not any("product_id" in c or "customer_id" in c for c in joins)


def test_release_tables_are_packed_with_zstd(spark, tmp_path):
    rows = spark.range(10).select(F.md5(F.col("id").cast("string")).alias("k"))
    write_observed(rows, "t", [], f"{tmp_path}/t")
    files = [f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
