"""Quality gates of the retail pipeline (D1-D7): raw -> gate -> models -> gate -> reports -> gate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.quality import RESULT_SCHEMA, Check, GateFailed, QualityGate, run_checks, schema_violations
from tallyspark.plans import retail_star as rs
from tallyspark.session import drop_scratch, materialize, scratch_dir, side_by_side, store
from tallyspark.sources.release import Release, write_observed

RAW_CONTRACT = {
    "InvoiceNo": "string", "StockCode": "string", "Quantity": "integer", "InvoiceDate": "string",
    "UnitPrice": "float64", "CustomerID": "float64", "Country": "string",
}
MODEL_CONTRACTS = {
    "dim_customer": {"customer_id": "string", "country": "string"},
    "dim_datetime": {"datetime_id": "string", "datetime": "datetime"},
    "dim_product": {"product_id": "string", "description": "string", "price": "float64"},
    "fct_invoices": {"invoice_id": "string", "product_id": "string", "customer_id": "string",
                     "datetime_id": "string", "quantity": "int", "total": "float64"},
}


def raw_checks() -> dict[str, list[Check]]:
    """Checks of the raw layer, which holds violations of every kind (they report, and do not stop a run)."""
    return {
        "raw_invoices": [
            Check("invoice number repeats", "duplicate", "InvoiceNo"),
            Check("bulk mark absent", "missing", "BulkMark"),
            Check("quantity outside 1..40", "invalid", "Quantity", valid_min=1, valid_max=40),
            Check("lowest unit price", "min", "UnitPrice", fail_op="<", threshold=1000),
            Check("lines above 45 pieces", "failed_rows", predicate=F.col("Quantity") > 45),
        ],
    }


def model_checks() -> dict[str, list[Check]]:
    """Checks of the model layer (dimensions and fact)."""
    return {
        "dim_customer": [
            Check("customer key repeats", "duplicate", "customer_id"),
            Check("customer key absent", "missing", "customer_id"),
        ],
        "dim_datetime": [
            Check("weekday outside 1..7", "invalid", "weekday", valid_min=1, valid_max=7),
            Check("datetime key repeats", "duplicate", "datetime_id"),
            Check("datetime key absent", "missing", "datetime_id"),
        ],
        "dim_product": [
            Check("product key repeats", "duplicate", "product_id"),
            Check("product key absent", "missing", "product_id"),
            Check("lowest price", "min", "price", fail_op="<", threshold=0),
        ],
        "fct_invoices": [
            Check("invoice key absent", "missing", "invoice_id"),
            Check("negative totals", "failed_rows", predicate=F.col("total") < 0),
        ],
    }


def report_checks() -> dict[str, list[Check]]:
    """Checks of the report layer."""
    return {
        "report_customer_invoices": [
            Check("country absent", "missing", "country"),
            Check("fewest invoices of a country", "min", "total_invoices", fail_op="<=", threshold=0),
        ],
        "report_product_invoices": [
            Check("stock code absent", "missing", "stock_code"),
            Check("least quantity sold", "min", "total_quantity_sold", fail_op="<=", threshold=0),
        ],
        "report_year_invoices": [
            Check("fewest invoices of a month", "min", "num_invoices", fail_op="<", threshold=0),
        ],
    }


def build_layers(raw: DataFrame, country: DataFrame, store=None) -> dict[str, DataFrame]:
    """raw -> models -> reports; ``store(df, name)`` (e.g. ``materialize``) persists each model as a table."""
    keep = store or (lambda df, name: df)
    dc, dd = keep(rs.dim_customer(raw, country), "dim_customer"), keep(rs.dim_datetime(raw), "dim_datetime")
    dp, fct = keep(rs.dim_product(raw), "dim_product"), keep(rs.fct_invoices(raw), "fct_invoices")
    # The reports join the fact to the dimensions even when the layers are
    # lazy: the dimension checks compute the same dimension stages, which AQE
    # reuses inside the query (measured faster here than the one-pass reports).
    reports = {
        "report_customer_invoices": rs.report_customer_invoices(fct, dc),
        "report_product_invoices": rs.report_product_invoices(fct, dp),
        "report_year_invoices": rs.report_year_invoices(fct, dd),
    }
    return {"raw_invoices": raw, "dim_customer": dc, "dim_datetime": dd, "dim_product": dp, "fct_invoices": fct,
            **reports}


def gate_results(raw: DataFrame, country: DataFrame, store=None) -> DataFrame:
    """One row per check of every layer: (table_name, check_name, metric, passed).

    With ``store`` given, every layer is written as a table in the shared
    scratch folder and its counting checks are metrics of that write; by
    default the plan stays lazy and the checks scan the layers.
    """
    spark = raw.sparkSession
    if store is not None:
        return _observed_results(raw, country)
    layers = build_layers(raw, country)
    out = spark.createDataFrame(_schema_rows(layers), RESULT_SCHEMA)
    layers["raw_invoices"] = layers["raw_invoices"].withColumns(bulk_mark())
    for name, checks in {**raw_checks(), **model_checks(), **report_checks()}.items():
        out = out.unionByName(run_checks(layers[name], name, checks))
    return out


def bulk_mark() -> dict:
    """A column that only a check of the raw layer sees."""
    return {"BulkMark": F.when(F.col("Quantity") > 25, "bulk")}


def _schema_rows(layers: dict[str, DataFrame]) -> list[tuple]:
    rows = []
    for name, c in {"raw_invoices": RAW_CONTRACT, **MODEL_CONTRACTS}.items():
        n_bad = len(schema_violations(layers[name], list(c), c))  # metadata only, no job
        rows.append((name, "schema", float(n_bad), n_bad == 0))
    return rows


def _observed_results(raw: DataFrame, country: DataFrame) -> DataFrame:
    """The layers written one after another, their counting checks taken from the writes themselves.

    Tables of one layer do not depend on each other and are written side by
    side; only duplicate checks read a key column of a stored table.
    """
    spark = raw.sparkSession
    rows: list[tuple] = []
    layers: dict[str, DataFrame] = {}
    again: list[DataFrame] = []

    def put(name: str, df: DataFrame, checks, extra=None) -> None:
        layers[name], found = write_observed(df, name, checks, scratch_dir(spark, name), extra)
        rows.extend(found)
        twice = [c for c in checks if c.kind == "duplicate"]
        if twice:
            again.append(run_checks(layers[name], name, twice))

    def put_all(tables: dict[str, DataFrame], checks) -> None:
        side_by_side([lambda n=n, df=df: put(n, df, checks[n]) for n, df in tables.items()])

    put("raw_invoices", raw, raw_checks()["raw_invoices"], bulk_mark())
    stored = layers["raw_invoices"]
    put_all({"dim_customer": rs.dim_customer(stored, country), "dim_datetime": rs.dim_datetime(stored),
             "dim_product": rs.dim_product(stored), "fct_invoices": rs.fct_invoices(stored)}, model_checks())
    fct = layers["fct_invoices"]
    put_all({"report_customer_invoices": rs.report_customer_invoices(fct, layers["dim_customer"]),
             "report_product_invoices": rs.report_product_invoices(fct, layers["dim_product"]),
             "report_year_invoices": rs.report_year_invoices(fct, layers["dim_datetime"])}, report_checks())
    out = spark.createDataFrame(_schema_rows(layers) + rows, RESULT_SCHEMA)
    for r in again:
        out = out.unionByName(r)
    return out


#: Models and reports in the order in which they depend on each other.
MODEL_ORDER = ["dim_customer", "dim_datetime", "dim_product", "fct_invoices", "report_customer_invoices",
               "report_product_invoices", "report_year_invoices"]


def release_models(raw: DataFrame, country: DataFrame, release: Release, checks: dict | None = None) -> None:
    """M1-M7 staged in dependency order, each from the versions staged before it, each behind its gate."""
    checks = {**model_checks(), **report_checks()} if checks is None else checks
    made: dict[str, DataFrame] = {}
    build = {
        "dim_customer": lambda: rs.dim_customer(raw, country), "dim_datetime": lambda: rs.dim_datetime(raw),
        "dim_product": lambda: rs.dim_product(raw), "fct_invoices": lambda: rs.fct_invoices(raw),
        "report_customer_invoices": lambda: rs.report_customer_invoices(made["fct_invoices"], made["dim_customer"]),
        "report_product_invoices": lambda: rs.report_product_invoices(made["fct_invoices"], made["dim_product"]),
        "report_year_invoices": lambda: rs.report_year_invoices(made["fct_invoices"], made["dim_datetime"]),
    }
    for name in MODEL_ORDER:
        made[name] = release.stage(name, build[name](), checks.get(name, ()), MODEL_CONTRACTS.get(name))


def released_twice(raw: DataFrame, country: DataFrame) -> DataFrame:
    """Q37: M1-M7 published, a release that its fact's gate stops, and a second release.

    The first release holds all invoice lines.  The next run reads only lines
    above 25 pieces and is stopped by a gate on the fact (no more than 45
    pieces a line): the reports behind it are not built and all tables stay.
    The last run reads the lines up to 45 pieces, passes the same gate and replaces all tables.
    Rows: table_name, first_rows, rows_after_failure, stopped_run (built, failed, not built), second_rows.
    """
    spark = raw.sparkSession
    raw, raw_path = store(raw, "raw_invoices")
    root, prefix = scratch_dir(spark, "release"), f"released_{uuid.uuid4().hex[:8]}_"
    strict = {**model_checks(), **report_checks()}
    strict["fct_invoices"] = [*strict["fct_invoices"], Check("lines above 45 pieces", "failed_rows", predicate=F.col("quantity") > 45)]

    def counts() -> dict[str, int]:
        return {n: spark.table(f"default.{prefix}{n}").count() for n in MODEL_ORDER}

    with Release(spark, root, prefix=prefix) as first:
        release_models(raw, country, first)
    before = counts()
    stopped = Release(spark, root, prefix=prefix)
    state = dict.fromkeys(MODEL_ORDER, "not built")
    try:
        release_models(raw.filter("Quantity > 25"), country, stopped, strict)
        stopped.publish()
    except GateFailed:
        state.update((n, "built") for n in stopped.staged)
        state.update((t, "failed") for t, _, _, good in stopped.results if not good)
        stopped.abandon()
    between = counts()
    with Release(spark, root, prefix=prefix) as second:
        release_models(raw.filter("Quantity <= 45"), country, second, strict)
    after = counts()
    for n in MODEL_ORDER:
        spark.sql(f"DROP TABLE default.{prefix}{n}")
    drop_scratch(spark, root)
    drop_scratch(spark, raw_path)
    return spark.createDataFrame([(n, before[n], between[n], state[n], after[n]) for n in MODEL_ORDER],
                                 "table_name string, first_rows long, rows_after_failure long, stopped_run string, second_rows long")


def enforce_all(raw: DataFrame, country: DataFrame, store=materialize) -> DataFrame:
    """raw -> gate -> models -> gate -> reports -> gate; raises ``GateFailed`` at the first failing layer.

    Each layer's gate runs before the next layer is built; by default every
    model is stored as a table before its gate (several checks and reports
    read it).  Returns the results of all checks.
    """
    raw_gate = QualityGate({"raw_invoices": (raw, [Check("InvoiceNo present", "missing", "InvoiceNo")])},
                           {"raw_invoices": (raw, list(RAW_CONTRACT), RAW_CONTRACT)})
    raw_res = raw_gate.enforce()
    keep = store or (lambda df, name: df)
    models = {
        "dim_customer": keep(rs.dim_customer(raw, country), "dim_customer"),
        "dim_datetime": keep(rs.dim_datetime(raw), "dim_datetime"),
        "dim_product": keep(rs.dim_product(raw), "dim_product"),
        "fct_invoices": keep(rs.fct_invoices(raw), "fct_invoices"),
    }
    model_gate = QualityGate({n: (models[n], c) for n, c in model_checks().items()},
                             {n: (models[n], list(c), c) for n, c in MODEL_CONTRACTS.items()})
    model_res = model_gate.enforce()
    reports = {
        "report_customer_invoices": rs.report_customer_invoices(models["fct_invoices"], models["dim_customer"]),
        "report_product_invoices": rs.report_product_invoices(models["fct_invoices"], models["dim_product"]),
        "report_year_invoices": rs.report_year_invoices(models["fct_invoices"], models["dim_datetime"]),
    }
    report_gate = QualityGate({n: (reports[n], c) for n, c in report_checks().items()})
    report_res = report_gate.enforce()
    return raw_res.unionByName(model_res).unionByName(report_res)


def failed_invoice_rows(raw: DataFrame) -> DataFrame:
    """The raw lines that fail the check of pieces per line (the failed-rows check's evidence)."""
    return raw.filter(F.col("Quantity") > 45).select("InvoiceNo", "StockCode", "Quantity")
