import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.quality import Check, GateFailed, QualityGate, run_checks, schema_violations
from tallyspark.plans.exercises import frequency_median, retention, warehouse_packing


def test_checks_metrics(spark):
    df = spark.createDataFrame([(1, 5, -1.0), (1, None, 2.0), (2, 8, 3.0), (None, 0, 4.0)], "k int, wd int, p double")
    res = {r.check_name: (r.metric, r.passed) for r in run_checks(df, "t", [
        Check("dup", "duplicate", "k"), Check("miss", "missing", "k"),
        Check("inv", "invalid", "wd", valid_min=1, valid_max=7), Check("min", "min", "p", fail_op="<", threshold=0),
        Check("rows", "failed_rows", predicate=F.col("p") > 3),
    ]).collect()}
    assert res == {"dup": (2.0, False), "miss": (1.0, False), "inv": (2.0, False), "min": (-1.0, False),
                   "rows": (1.0, False)}


def test_gate_raises_and_schema(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    assert schema_violations(df, ["id", "x"], {"id": "string"}) == ["missing column x",
                                                                    "wrong type id: int (expected string)"]
    with pytest.raises(GateFailed):
        QualityGate({"t": (df, [Check("m", "missing", "name")])}, {"t": (df, ["x"], {})}).enforce()
    ok = QualityGate({"t": (df, [Check("m", "missing", "name")])}).enforce()
    assert ok.count() == 1


def test_retention_year_match_vs_month_only(spark):
    rows = [(1, dt.date(2022, 7, 3)), (1, dt.date(2022, 6, 9)), (2, dt.date(2022, 7, 1)), (2, dt.date(2021, 6, 1)),
            (3, dt.date(2022, 7, 31)), (3, dt.date(2022, 5, 31))]
    df = spark.createDataFrame(rows, "user_id int, event_date date")
    assert retention(df, 7, 2022, True).first().monthly_active_users == 1
    assert retention(df, 7, 2022, False).first().monthly_active_users == 2


def test_packing_and_empty_prime_class(spark):
    inv = spark.createDataFrame([("prime_eligible", 100), ("prime_eligible", 400), ("not_prime", 300)],
                                "item_type string, square_footage long")
    got = {r.item_type: r.item_count for r in warehouse_packing(inv, 500_000).collect()}
    assert got == {"prime_eligible": 2000, "not_prime": 0}
    only_np = spark.createDataFrame([("not_prime", 300)], "item_type string, square_footage long")
    assert {r.item_type: r.item_count for r in warehouse_packing(only_np).collect()} == {"not_prime": None}


def test_frequency_median_vs_expansion(spark):
    freq = [(1, 3), (2, 0), (3, 4), (5, 1), (3, 2)]   # duplicate value 3 -> max(n) = 4, n = 0 ignored
    df = spark.createDataFrame(freq, "searches long, num_users long")
    got = frequency_median(df).first().median
    expanded = [1] * 3 + [3] * 4 + [5]
    assert got == round(statistics.median(expanded), 1)
    got_sum = frequency_median(df, combine="sum").first().median
    assert got_sum == round(statistics.median([1] * 3 + [3] * 6 + [5]), 1)
