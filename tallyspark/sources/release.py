"""Catalog tables replaced as a whole (S8, S11), with gates taken while a table is written.

A release writes every table as a new version beside the current one.  Its
counting checks are ``observe`` metrics of that very write, so a gate costs no
second scan; only duplicate checks read the key column again.  When all tables
are staged and all gates passed, each catalog table is switched to its new
version by one change of its location: a reader sees the old rows or the new
ones, never half a table.  A run that fails anywhere leaves the old versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession

from tallyspark.operators.quality import Check, GateFailed, metric_column, passes, run_checks, schema_violations
from tallyspark.session import drop_scratch

Result = tuple[str, str, float | None, bool]


def write_observed(df: DataFrame, table: str, checks: Sequence[Check], path: str,
                   extra: dict | None = None) -> tuple[DataFrame, list[Result]]:
    """Writes ``df`` to ``path``; the table read back, and the results of its counting checks from that write.

    ``extra`` gives columns that only the checks see.  Duplicate checks are not among the results.
    """
    counted = [c for c in checks if c.kind != "duplicate"]
    rows = df.withColumns(extra) if extra else df
    if counted:
        seen = Observation(f"gate_{table}_{uuid.uuid4().hex[:8]}")
        rows = rows.observe(seen, *[metric_column(c).alias(f"m{i}") for i, c in enumerate(counted)])
    rows.select(*df.columns).write.option("compression", "zstd").parquet(path)  # hashed keys shrink to half, which snappy leaves whole
    results = []
    for i, c in enumerate(counted):
        m = seen.get[f"m{i}"]
        results.append((table, c.name, None if m is None else float(m), passes(c, m)))
    return df.sparkSession.read.schema(df.schema).parquet(path), results


class Release:
    """One run's new table versions: ``with Release(...) as r: r.stage(...)`` publishes at the end, or nothing."""

    def __init__(self, spark: SparkSession, root: str, database: str = "default", prefix: str = ""):
        self.spark, self.root, self.database, self.prefix = spark, root.rstrip("/"), database, prefix
        self.staged: dict[str, tuple[DataFrame, str]] = {}
        self.results: list[Result] = []
        self.replaced: list[str] = []

    def __enter__(self) -> Release:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.publish()
        else:
            self.abandon()

    def table_name(self, name: str) -> str:
        return f"{self.database}.{self.prefix}{name}"

    def stage(self, name: str, df: DataFrame, checks: Sequence[Check] = (), contract: dict[str, str] | None = None,
              extra: dict | None = None) -> DataFrame:
        """Writes a new version and judges it; later tables of the run are built from what this returns.

        Raises ``GateFailed`` before any later table is built.
        """
        problems = [f"{name}: {v}" for v in schema_violations(df, list(contract or {}), contract)]
        if problems:
            raise GateFailed("; ".join(problems))
        path = f"{self.root}/{name}/v-{uuid.uuid4().hex[:12]}"
        stored, results = write_observed(df, name, checks, path, extra)
        self.staged[name] = (stored, path)
        again = [c for c in checks if c.kind == "duplicate"]
        if again:
            results += [tuple(r) for r in run_checks(stored, name, again).collect()]  # one row a check
        self.results += results
        failed = [f"{t}: {c} (metric={m})" for t, c, m, good in results if not good]
        if failed:
            raise GateFailed("; ".join(failed))
        return stored

    def _location(self, table: str) -> str | None:
        """Where a catalog table's current version lies."""
        if not self.spark.catalog.tableExists(table):
            return None
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").collect()
        return rows[0].data_type if rows else None

    def publish(self) -> None:
        """Switches every staged table; if one switch fails, those done before are switched back."""
        done: list[tuple[str, str | None]] = []
        try:
            for name, (df, path) in self.staged.items():
                table = self.table_name(name)
                old = self._location(table)
                if old is not None and self.spark.table(table).schema != df.schema:
                    self.spark.sql(f"DROP TABLE {table}")  # another layout cannot be switched to
                    old_rows, old = old, None
                    self.replaced.append(old_rows)
                if old is None:
                    self.spark.catalog.createTable(table, path=path, source="parquet", schema=df.schema)
                else:
                    self.spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
                    self.replaced.append(old)
                self.spark.catalog.refreshTable(table)
                done.append((table, old))
        except Exception:
            for table, old in reversed(done):
                self.spark.sql(f"DROP TABLE {table}" if old is None else f"ALTER TABLE {table} SET LOCATION '{old}'")
            self.abandon()
            raise
        self.staged = {}

    def abandon(self) -> None:
        """Deletes what was staged; the published tables stay as they are."""
        for _, path in self.staged.values():
            drop_scratch(self.spark, path)
        self.staged = {}

    def vacuum(self) -> None:
        """Deletes the versions that this release replaced, once no reader uses them any more."""
        for path in self.replaced:
            drop_scratch(self.spark, path)
        self.replaced = []
