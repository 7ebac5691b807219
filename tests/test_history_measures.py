import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators.history import current_version, latest_row
from tallyspark.operators.joins import role_flags
from tallyspark.operators.measures import Metric, null_when_key_null, penetration, weighted_average


def test_latest_row_equals_row_number_with_total_order(spark):
    rows = [(1, dt.date(2020, 1, 1), 1, 10.0), (1, dt.date(2020, 1, 2), 1, 5.0), (1, dt.date(2020, 1, 2), 2, 1.0),
            (2, dt.date(2019, 1, 1), 1, 3.0), (2, dt.date(2019, 1, 1), 1, 4.0), (3, None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k int, d date, n int, v double")
    got = sorted(tuple(r) for r in latest_row(df, "k", ["d", "n", "v"]).collect())
    w = Window.partitionBy("k").orderBy(F.desc_nulls_last("d"), F.desc("n"), F.desc("v"))
    exp = sorted(tuple(r) for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").collect())
    assert got == exp


def test_current_version(spark):
    df = spark.createDataFrame([(1, "5999-12-31 00:00:00", "0"), (2, "5999-12-31 00:00:00", "1"),
                                (3, "2020-01-01 00:00:00", "0")], "k int, t string, del string")
    df = df.withColumn("effective_to", F.col("t").cast("timestamp")).withColumnRenamed("del", "deleted_flg")
    assert [r.k for r in current_version(df).collect()] == [1]


def test_penetration_zero_denominator_and_null_key(spark):
    rows = [("A", "P", 1, 100.0), ("A", "P", 0, 50.0), ("B", "AB", 1, 10.0), (None, "P", 1, 5.0)]
    df = spark.createDataFrame(rows, "mac string, product string, hit int, amt double")
    ms = [Metric("m1", F.col("hit") == 1, F.col("product") != "AB"), Metric("m2", F.col("hit") == 1)]
    pen = null_when_key_null(penetration(df, "mac", ms, "amt"), "mac", ["m1_penet_sht", "m1_penet_rub",
                                                                         "m2_penet_sht", "m2_penet_rub"])
    got = {r.mac: r for r in pen.collect()}
    assert got["A"].m1_penet_sht == 0.5 and abs(got["A"].m1_penet_rub - 100 / 150) < 1e-6
    assert got["B"].m1_penet_sht is None and got["B"].m1_penet_rub is None   # empty population -> NULL
    assert got["B"].m2_penet_sht == 1.0
    assert got[None].m2_penet_sht is None                                     # NULL key never matches


def test_weighted_average_zero_weight(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 1.0), ("b", 4.0, 3.0)], "k string, x double, w double")
    got = {r.k: r.wa for r in df.groupBy("k").agg(weighted_average(F.col("x"), F.col("w")).alias("wa")).collect()}
    assert got["a"] is None and got["b"] == 3.5


def test_role_flags(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    roles = spark.createDataFrame([(1, 1), (1, 1), (1, 3), (2, 2)], "cid int, role int")
    out = {r.id: (r.a, r.b, r.c) for r in role_flags(base, "id", roles, "cid", "role",
                                                     {"a": 1, "b": 2, "c": 3}).collect()}
    assert out == {1: (1, 0, 1), 2: (0, 1, 0), 3: (0, 0, 0)}


def test_effective_dated_lookup_priorities_gaps_and_nulls(spark):
    from tallyspark.operators.joins import effective_dated_lookup, resolve_effective_rules

    rules = [(0, dt.date(2020, 1, 10), dt.date(2020, 1, 20), "A"), (1, dt.date(2020, 1, 1), dt.date(2020, 2, 28), "B"),
             (2, dt.date(2019, 12, 25), dt.date(2021, 3, 1), "C"), (3, dt.date(2022, 1, 1), dt.date(2022, 1, 1), "D")]
    rdf = spark.createDataFrame(rules, "priority int, valid_from date, valid_to date, v string")
    days = [dt.date(2019, 12, 24), dt.date(2019, 12, 25), dt.date(2020, 1, 9), dt.date(2020, 1, 10),
            dt.date(2020, 1, 20), dt.date(2020, 1, 21), dt.date(2020, 3, 1), dt.date(2021, 3, 1),
            dt.date(2021, 3, 2), dt.date(2022, 1, 1), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d date")
    out = {r.i: r.v for r in effective_dated_lookup(df, "d", resolve_effective_rules(rdf, "v"), "v").collect()}

    def brute(d):
        hits = sorted((p, v) for p, f, t, v in rules if d is not None and f <= d <= t)
        return hits[0][1] if hits else None

    assert out == {i: brute(d) for i, d in enumerate(days)}


def test_constant_per_group_left_lookup_and_view(spark):
    from tallyspark.operators.joins import left_lookup
    from tallyspark.operators.measures import constant_per_group
    from tallyspark.sources.io import register_view

    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), (None, 4)], "mac string, office int")
    assert sorted((r.mac or "", r.plan) for r in constant_per_group(df, "mac", "plan", 0).collect()) == \
        [("", 0), ("A", 0), ("B", 0)]
    dim = spark.createDataFrame([(1, "x", "1"), (2, "y", "0")], "office int, name string, active string")
    out = {r.office: r.name for r in left_lookup(df, dim, "office", F.col("active") == "1").collect()}
    assert out == {1: "x", 2: None, 3: None, 4: None}      # right-side filter inside ON, rows kept
    register_view(df, "panel_view")
    assert spark.sql("SELECT count(*) AS n FROM panel_view").first().n == 4
