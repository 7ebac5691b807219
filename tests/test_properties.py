"""Property tests: custom operators vs brute-force Python on random small frames."""

import os
import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.operators.history import latest_row
from tallyspark.operators.pivoting import composition_signature, positional_crosstab
from tallyspark.operators.windows import rank_rows
from tallyspark.plans.exercises import frequency_median

# TALLYSPARK_PROPERTY_EXAMPLES raises the example count for a longer run
SETTINGS = settings(max_examples=int(os.environ.get("TALLYSPARK_PROPERTY_EXAMPLES", "8")), deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
keys = st.sampled_from(["a", "b", "c", None])
vals = st.sampled_from(["P", "Q", "R", "S", "T"])


@SETTINGS
@given(st.lists(st.tuples(keys, vals), min_size=1, max_size=40), st.integers(1, 4))
def test_positional_crosstab_property(spark, rows, n):
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: tuple(r[f"s{i}"] for i in range(1, n + 1))
           for r in positional_crosstab(df, "k", "v", n, prefix="s").collect()}
    exp = {}
    for k in {k for k, _ in rows}:
        vs = sorted(v for kk, v in rows if kk == k)[:n]
        exp[k] = tuple(vs + [None] * (n - len(vs)))
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(keys, st.one_of(vals, st.none())), min_size=1, max_size=40), st.integers(1, 4))
def test_composition_signature_property(spark, rows, m):
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: r.sig for r in composition_signature(df, ["k"], "v", m, "&", "sig").collect()}
    exp = {}
    for k in {k for k, _ in rows}:
        items = sorted({v for kk, v in rows if kk == k and v is not None})[:m]
        if items:
            exp[k] = "&".join(items)
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(keys, st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=40))
def test_latest_row_property(spark, rows):
    df = spark.createDataFrame(rows, "k string, d int, x int")
    got = {r.k: (r.d, r.x) for r in latest_row(df, "k", ["d", "x"]).collect()}
    exp = {k: max((d, x) for kk, d, x in rows if kk == k) for k in {k for k, _, _ in rows}}
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(keys, st.integers(0, 9)), min_size=1, max_size=60), st.integers(1, 5))
def test_rank_rows_property(spark, rows, parts):
    data = [(k, a, i) for i, (k, a) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, amt int, id int")
    got = {r.id: r.rn for r in rank_rows(df, "g", [F.col("amt").desc(), F.col("id").asc()], "rn", parts).collect()}
    exp = {}
    for g in {g for g, _, _ in data}:
        members = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        exp.update({r[2]: i + 1 for i, r in enumerate(members)})
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 6)), min_size=1, max_size=15))
def test_frequency_median_property(spark, rows):
    df = spark.createDataFrame(rows, "searches long, num_users long")
    got = frequency_median(df).first().median
    per_value = {}
    for v, n in rows:
        per_value[v] = max(per_value.get(v, 0), n)
    expanded = [v for v, n in per_value.items() for _ in range(n)]
    exp = round(statistics.median(expanded), 1) if expanded else None
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 40), st.sampled_from("VWXYZ")), min_size=1, max_size=8),
       st.lists(st.one_of(st.integers(-5, 110), st.none()), min_size=1, max_size=25))
def test_effective_dated_lookup_property(spark, rules, days):
    import datetime as dt

    from tallyspark.operators.joins import effective_dated_lookup, resolve_effective_rules

    base = dt.date(2019, 12, 20)
    rule_rows = [(i, base + dt.timedelta(days=s), base + dt.timedelta(days=s + n), v) for i, (s, n, v) in enumerate(rules)]
    rdf = spark.createDataFrame(rule_rows, "priority int, valid_from date, valid_to date, v string")
    dates = [None if d is None else base + dt.timedelta(days=d) for d in days]
    df = spark.createDataFrame(list(enumerate(dates)), "i int, d date")
    got = {r.i: r.v for r in effective_dated_lookup(df, "d", resolve_effective_rules(rdf, "v"), "v").collect()}

    def brute(d):
        hits = sorted((p, v) for p, f, t, v in rule_rows if d is not None and f <= d <= t)
        return hits[0][1] if hits else None

    assert got == {i: brute(d) for i, d in enumerate(dates)}
