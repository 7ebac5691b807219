"""Conditional classification (C1-C15): rule lists compiled into one CASE expression.

Rules are data (ordered lists of (predicate, label)), folded into a single
``CASE WHEN`` so the whole ladder stays inside whole-stage codegen with no join.
Pair lists that would be long ladders become a broadcast lookup instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """First-match label rules: ``CASE WHEN p1 THEN l1 WHEN p2 THEN l2 ... ELSE default``."""
    if not rules:
        return F.lit(default)
    expr = None
    for pred, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        expr = F.when(pred, value) if expr is None else expr.when(pred, value)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def code_override(code: Column, overrides: Iterable[tuple[Iterable, str]], fallback: Column) -> Column:
    """Code-list override, else the dimension value."""
    rules = [(code.isin(list(codes)), label) for codes, label in overrides]
    return F.coalesce(first_match(rules, None), fallback) if rules else fallback


def merge_codes(code: Column, codes: Iterable, label: str) -> Column:
    """Merge several codes into one label, keep every other code."""
    return F.when(code.isin(list(codes)), F.lit(label)).otherwise(code)


def membership_label(col: Column, members: Iterable, yes: str, no: str) -> Column:
    """Membership flag against a list (C4); NULL counts as not a member."""
    return F.when(col.isin(list(members)), F.lit(yes)).otherwise(F.lit(no))


def value_map(col: Column, mapping: dict, default: str) -> Column:
    """Small value map with a default for unknown values."""
    return first_match([(col == F.lit(k), v) for k, v in mapping.items()], default)


def pair_flag(df: DataFrame, pairs_df: DataFrame, keys: list[str], flag: str, also: Column | None = None) -> DataFrame:
    """Two-column membership flag (C5): 1 when (k1, k2) is in ``pairs_df`` or ``also`` holds.

    ``pairs_df`` is a rule table whose size is fixed by its definition; it is
    de-duplicated; Spark broadcasts it while it is below its size threshold.
    """
    marks = pairs_df.select(*keys).distinct().withColumn("__hit", F.lit(1))
    out = df.join(marks, keys, "left")
    cond = F.col("__hit").isNotNull()
    if also is not None:
        cond = also | cond
    return out.withColumn(flag, F.when(cond, 1).otherwise(0)).drop("__hit")


def count_bucket(col: Column, top: int = 3, over_label: str = "over", error_label: str = "error") -> Column:
    """Count bucket: '0', '1', ... str(top), ``over_label`` above, ``error_label`` for NULL."""
    rules = [(col == i, str(i)) for i in range(top + 1)]
    rules.append((col > top, over_label))
    return first_match(rules, error_label)


def size_bucket(n: Column, labels: Sequence[str], over_label: str, error_label: str = "error") -> Column:
    """Composition size label from a separator count (C11): labels[i] for n == i."""
    rules = [(n == i, lab) for i, lab in enumerate(labels)]
    rules.append((n > len(labels) - 1, over_label))
    return first_match(rules, error_label)
