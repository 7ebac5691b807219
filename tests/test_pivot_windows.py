import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators.pivoting import (
    composition_signature,
    conditional_max_pivot,
    pivot_top_n,
    positional_crosstab,
    record_transpose,
)
from tallyspark.operators.windows import lag_growth, rank_rows


def test_positional_crosstab_by_position_overflow_and_missing(spark):
    rows = [("c1", "B"), ("c1", "A"), ("c1", "D"), ("c1", "C"), ("c2", "Z")]
    df = spark.createDataFrame(rows, "k string, v string")
    got = {r.k: (r.v1, r.v2, r.v3) for r in positional_crosstab(df, "k", "v", 3, prefix="v").collect()}
    assert got == {"c1": ("A", "B", "C"), "c2": ("Z", None, None)}


def test_composition_signature_more_than_ten_items(spark):
    items = [f"T{i:02d}" for i in range(12)] + ["T00", None]
    df = spark.createDataFrame([("w", "c", t) for t in items], "w string, c string, t string")
    r = composition_signature(df, ["w", "c"], "t", 10, "&", "sig").first()
    assert r.sig == "&".join(f"T{i:02d}" for i in range(10)) and r.sig_size == 12


def test_conditional_max_pivot(spark):
    df = spark.createDataFrame([(1, 6, "X", 5.0), (1, 6, "Y", 7.0), (1, 13, "L", 1.0), (2, 30, "O", 2.0)],
                               "k int, t int, nm string, amt double")
    out = {r.k: r for r in conditional_max_pivot(df, ["k"], "t", {6: "cc", 13: "life"},
                                                 {"nm": "nm", "amt": "amt"}).collect()}
    assert (out[1].cc_nm, out[1].cc_amt, out[1].life_nm) == ("Y", 7.0, "L")   # independent MAX per column
    assert out[2].cc_nm is None and out[2].life_amt is None


def test_record_transpose_and_top_n_pivot(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 9, "q")],
                               "k string, n int, s string")
    tr = {(r.k, r.col): (r.r1, r.r2) for r in record_transpose(df, "k", [F.col("n").asc()], ["n", "s"], 2).collect()}
    assert tr[("a", "n")] == ("1", "2") and tr[("a", "s")] == ("x", "y") and tr[("b", "s")] == ("q", None)
    pv = {r.k: r for r in pivot_top_n(df, "k", [F.col("n").desc()], ["s"], 2, extra=["n"]).collect()}
    assert (pv["a"].n, pv["a"].s_1, pv["a"].s_2) == (3, "z", "y") and pv["b"].s_2 is None


def test_rank_rows_matches_window_on_skewed_groups(spark):
    random.seed(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else (None if i % 97 == 0 else f"g{random.randint(0, 40)}")
        rows.append((g, random.randint(0, 50), i))
    df = spark.createDataFrame(rows, "g string, amt int, id int").repartition(6)
    order = [F.col("amt").desc_nulls_last(), F.col("id").asc()]
    got = sorted((r.g or "", r.id, r.rn) for r in rank_rows(df, "g", order, "rn", 8).collect())
    w = Window.partitionBy("g").orderBy(*order)
    exp = sorted((r.g or "", r.id, r.rn) for r in df.withColumn("rn", F.row_number().over(w)).collect())
    assert got == exp and len(got) == 3000


def test_lag_growth_zero_previous(spark):
    df = spark.createDataFrame([("p", 2020, 0.0), ("p", 2021, 10.0), ("p", 2022, 15.0)],
                               "p string, y int, v double")
    out = [(r.y, r.prev, r.rate) for r in lag_growth(df, "p", "y", "v", "prev", "rate").orderBy("y").collect()]
    assert out == [(2020, None, None), (2021, 0.0, None), (2022, 10.0, 50.0)]


def test_rank_rows_with_kept_columns_and_a_hot_group(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("amt"), "id", F.concat(F.lit("row "), "id").alias("note"))
    order = [F.col("amt").desc(), F.col("id").asc()]
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            got = rank_rows(df, "g", order, "rn", 8)
            both = got.join(want.select("id", "want"), "id")
            assert both.filter("rn <> want").count() == 0 and both.count() == 120_000
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
