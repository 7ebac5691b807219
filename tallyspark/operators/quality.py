"""Data-quality gates.

All count/min checks of one table run in ONE aggregate pass; each duplicate
check is one partially aggregated ``groupBy(col)``.  Results are a small
DataFrame (one row per check); only ``QualityGate.enforce`` brings that result
(never the data) to the driver to decide pass/fail.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = "table_name string, check_name string, metric double, passed boolean"

_SIMPLE_TYPES = {
    "string": (T.StringType,),
    "integer": (T.IntegerType, T.LongType, T.ShortType),
    "int": (T.IntegerType, T.LongType, T.ShortType),
    "float64": (T.DoubleType,),
    "datetime": (T.TimestampType, T.TimestampNTZType),
}


@dataclass(frozen=True)
class Check:
    """One check: ``kind`` in missing | duplicate | invalid | min | failed_rows.

    missing/duplicate/invalid/failed_rows pass when the count is 0; ``min``
    passes when ``min(col) <op> threshold`` does NOT hold (a fail condition).
    """

    name: str
    kind: str
    column: str | None = None
    valid_min: float | None = None
    valid_max: float | None = None
    fail_op: str | None = None  # for kind == "min": "<" or "<="
    threshold: float | None = None
    predicate: Column | None = None  # for kind == "failed_rows"


def schema_violations(df: DataFrame, required: Sequence[str], types: dict[str, str] | None = None) -> list[str]:
    """Required columns present and column types as declared (metadata only, no job)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = [f"missing column {c}" for c in required if c not in fields]
    for c, t in (types or {}).items():
        if c in fields and not isinstance(fields[c], _SIMPLE_TYPES[t]):
            out.append(f"wrong type {c}: {fields[c].simpleString()} (expected {t})")
    return out


def metric_column(c: Check) -> Column:
    """The aggregate that a counting check measures (also usable in ``observe``)."""
    col = F.col(c.column) if c.column else None
    if c.kind == "missing":
        m = F.sum(F.when(col.isNull(), 1).otherwise(0))
    elif c.kind == "invalid":
        bad = F.lit(False)
        if c.valid_min is not None:
            bad = bad | (col < F.lit(c.valid_min))
        if c.valid_max is not None:
            bad = bad | (col > F.lit(c.valid_max))
        m = F.sum(F.when(col.isNotNull() & bad, 1).otherwise(0))
    elif c.kind == "failed_rows":
        m = F.sum(F.when(c.predicate, 1).otherwise(0))
    elif c.kind == "min":
        m = F.min(col)
    else:
        raise ValueError(c.kind)
    return m.cast("double")


def passes(c: Check, metric: float | None) -> bool:
    """The verdict on a measured metric; a table without rows meets every counting check."""
    if c.kind != "min":
        return not metric
    if c.fail_op not in ("<", "<="):
        raise ValueError(c.fail_op)
    return metric is None or not (metric < c.threshold or (c.fail_op == "<=" and metric == c.threshold))


def run_checks(df: DataFrame, table: str, checks: Sequence[Check]) -> DataFrame:
    """Evaluate ``checks`` on ``df``; one row per check (table_name, check_name, metric, passed)."""
    spark = df.sparkSession
    one_pass = [c for c in checks if c.kind in ("missing", "invalid", "min", "failed_rows")]
    parts: list[DataFrame] = []
    if one_pass:
        aggs = [metric_column(c).alias(f"m{i}") for i, c in enumerate(one_pass)]
        row = df.agg(*aggs)
        stack = F.explode(F.array(*[
            F.struct(F.lit(c.name).alias("check_name"), F.col(f"m{i}").alias("metric"),
                     _passed(c, F.col(f"m{i}")).alias("passed"))
            for i, c in enumerate(one_pass)
        ])).alias("r")
        parts.append(row.select(stack).select(F.lit(table).alias("table_name"), "r.*"))
    for c in checks:
        if c.kind == "duplicate":
            dup = (df.filter(F.col(c.column).isNotNull()).groupBy(c.column).count()
                   .filter(F.col("count") > 1).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("metric")))
            parts.append(dup.select(F.lit(table).alias("table_name"), F.lit(c.name).alias("check_name"),
                                    "metric", (F.col("metric") == 0).alias("passed")))
    if not parts:
        return spark.createDataFrame([], RESULT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _passed(c: Check, m: Column) -> Column:
    if c.kind == "min":
        if c.fail_op == "<":
            fail = m < F.lit(c.threshold)
        elif c.fail_op == "<=":
            fail = m <= F.lit(c.threshold)
        else:
            raise ValueError(c.fail_op)
        return F.coalesce(~fail, F.lit(True))
    return m == 0


def failed_rows(df: DataFrame, predicate: Column, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows that fail a rule (the 'failed rows' check); ``limit`` caps only the evidence shown."""
    out = df.filter(predicate).select(*cols)
    return out.limit(limit) if limit is not None else out


class GateFailed(ValueError):
    pass


class QualityGate:
    """Run checks for a layer and raise if any fails (the scan -> raise step of the pipeline)."""

    def __init__(self, checks_by_table: dict[str, tuple[DataFrame, Sequence[Check]]],
                 schemas: dict[str, tuple[DataFrame, Sequence[str], dict[str, str]]] | None = None):
        self.checks_by_table = checks_by_table
        self.schemas = schemas or {}

    def results(self) -> DataFrame:
        parts = [run_checks(df, name, checks) for name, (df, checks) in self.checks_by_table.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def enforce(self) -> DataFrame:
        problems = []
        for name, (df, req, types) in self.schemas.items():
            problems += [f"{name}: {v}" for v in schema_violations(df, req, types)]
        res = self.results()
        failed = res.filter(~F.col("passed")).collect()  # one row per failed check, tiny
        problems += [f"{r.table_name}: {r.check_name} (metric={r.metric})" for r in failed]
        if problems:
            raise GateFailed("; ".join(problems))
        return res
