"""Copies, staging writes, CSV loads.

Writes are full replacements (``mode("overwrite")``), the Spark form of the
reference's drop + CTAS and ``if_exists='replace'``.  Row counts of a copy are
taken from the write itself with an ``Observation`` (one pass over the data),
never by collecting rows.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.session import materialize, side_by_side
from tallyspark.sources.tables import load

# The raw invoice contract (column -> type) with the Description column that
# the models read.
RAW_INVOICE_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType(), True),
    T.StructField("StockCode", T.StringType(), True),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Quantity", T.IntegerType(), True),
    T.StructField("InvoiceDate", T.StringType(), True),
    T.StructField("UnitPrice", T.DoubleType(), True),
    T.StructField("CustomerID", T.DoubleType(), True),
    T.StructField("Country", T.StringType(), True),
])


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table from a query (drop + CTAS)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Named view over a query."""
    df.createOrReplaceTempView(name)
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its (local, HDFS, object-store) file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath))


def discover_tables(spark: SparkSession, src_dir: str, names: list[str]) -> list[str]:
    """Tables from ``names`` that exist under ``src_dir`` (a file-system listing, no job)."""
    return [n for n in names if path_exists(spark, os.path.join(src_dir, f"{n}.parquet"))]


def discover_catalog_tables(spark: SparkSession, names: list[str], database: str | None = None) -> list[str]:
    """Tables (or views) of the session catalog whose name is in ``names``, in list order."""
    present = {t.name for t in spark.catalog.listTables(database)}
    return [n for n in names if n in present]


AUDIT_SCHEMA = "table_name string, rows_imported long, seconds double, status string"


def _copied(name: str, read, dst_dir: str, prefix: str) -> tuple:
    """One copy's audit row; an error is its status, so that the other copies finish."""
    start = time.monotonic()
    try:
        obs = Observation(f"copy_{name}")
        replace_table(read().observe(obs, F.count(F.lit(1)).alias("rows")), os.path.join(dst_dir, f"{prefix}{name}.parquet"))
        rows, status = int(obs.get["rows"]), "loaded"
    except Exception as e:  # noqa: BLE001 - the audit reports whatever went wrong with a source
        rows, status = None, f"failed: {type(e).__name__}"
    return name, rows, round(time.monotonic() - start, 3), status


def _audited(spark: SparkSession, audit: list[tuple], on_error: str) -> DataFrame:
    failed = [f"{n} ({status})" for n, _, _, status in audit if status != "loaded"]
    if failed and on_error == "raise":
        raise RuntimeError("copies failed: " + ", ".join(failed))
    return spark.createDataFrame(audit, AUDIT_SCHEMA)


def copy_tables(spark: SparkSession, src_dir: str, names: list[str], dst_dir: str, prefix: str = "src_",
                on_error: str = "raise") -> DataFrame:
    """Copy named tables (full replace), side by side; returns a load audit: table, rows, seconds, status.

    All copies are submitted at once, each with its own ``Observation``; a
    failing table does not stop the others.  ``on_error`` is "raise" (after all
    have ended) or "report" (the failure is the table's status, its rows NULL).
    """
    if on_error not in ("raise", "report"):
        raise ValueError(on_error)
    audit = side_by_side([lambda n=n: _copied(n, lambda: load(spark, src_dir, n), dst_dir, prefix) for n in names])
    return _audited(spark, audit, on_error)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header row (full replace)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType = RAW_INVOICE_SCHEMA) -> DataFrame:
    """CSV -> typed raw table: explicit schema, PERMISSIVE rows, no NULL-token parsing ('NA' stays text)."""
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("nullValue", None).csv(path))


def read_csv_quarantine(spark: SparkSession, path: str, schema: T.StructType = RAW_INVOICE_SCHEMA,
                        header: bool = True) -> tuple[DataFrame, DataFrame]:
    """CSV -> (typed rows, rejected rows) from one read of the files.

    A line with too few or too many fields, or with a value that does not fit
    its column, is rejected as it stands: (file, line).  The parsed rows are
    stored once, so that both results come from the same parse.
    """
    bad = "_corrupt_line"
    while bad in schema.names:
        bad = "_" + bad
    parsed = (spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType(), True)]))
              .option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
              .option("nullValue", None).csv(path).select("*", F.col("_metadata.file_name").alias("_file")))
    stored = materialize(parsed, "csv")
    typed = stored.filter(F.col(bad).isNull()).select(*schema.names)
    return typed, stored.filter(F.col(bad).isNotNull()).select(F.col("_file").alias("file"), F.col(bad).alias("line"))


def discover_jdbc_tables(spark: SparkSession, url: str, names: list[str], properties: dict | None = None,
                         catalog_query: str = "SELECT name FROM sys.tables") -> list[str]:
    """Tables of a JDBC source whose name is in ``names`` (the catalog query runs in the database).

    Not exercised by the tests: no database may be started in this environment.
    """
    listed = (spark.read.format("jdbc").option("url", url).option("query", catalog_query)
              .options(**(properties or {})).load())
    present = {r[0] for r in listed.collect()}  # table names only, a handful of rows
    return [n for n in names if n in present]


def copy_jdbc_tables(spark: SparkSession, url: str, names: list[str], dst_dir: str,
                     partitioning: dict[str, tuple[str, int, int, int]] | None = None,
                     properties: dict | None = None, prefix: str = "src_") -> DataFrame:
    """Copy JDBC tables to parquet (full replace) with a load audit.

    ``partitioning[name] = (column, lower, upper, num_partitions)`` splits the
    read into parallel range queries, so no table passes through one worker.
    Not exercised by the tests: no database may be started in this environment.
    """
    def read(n: str) -> DataFrame:
        part, props = (partitioning or {}).get(n), dict(properties or {})
        if not part:
            return spark.read.jdbc(url, n, properties=props)
        col, lo, hi, k = part
        return spark.read.jdbc(url, n, column=col, lowerBound=lo, upperBound=hi, numPartitions=k, properties=props)

    audit = side_by_side([lambda n=n: _copied(n, lambda: read(n), dst_dir, prefix) for n in names])
    return _audited(spark, audit, "raise")
