from pyspark.sql import functions as F

from tallyspark.operators.classify import (
    code_override,
    count_bucket,
    first_match,
    merge_codes,
    pair_flag,
    size_bucket,
    value_map,
)


def test_first_match_order_and_default(spark):
    df = spark.createDataFrame([("KICK DOWN LOCAL",), ("KICK",), ("NONE",), (None,)], "n string")
    lab = first_match([(F.col("n").contains("LOCAL"), "local"), (F.col("n").contains("KICK"), "kick")], "other")
    assert [r.l for r in df.select(lab.alias("l")).collect()] == ["local", "kick", "other", "other"]


def test_code_override_then_dimension(spark):
    df = spark.createDataFrame([(1, "R1"), (2, "R2"), (None, None)], "code int, region string")
    lab = code_override(F.col("code"), [((1, 5), "City")], F.col("region"))
    assert [r.l for r in df.select(lab.alias("l")).collect()] == ["City", "R2", None]


def test_merge_and_map(spark):
    df = spark.createDataFrame([("A1",), ("A2",), ("B",), (None,)], "c string")
    out = df.select(merge_codes(F.col("c"), ["A1", "A2"], "AE").alias("m"),
                    value_map(F.col("c"), {"B": "bee"}, "unknown").alias("v")).collect()
    assert [r.m for r in out] == ["AE", "AE", "B", None]
    assert [r.v for r in out] == ["unknown", "unknown", "bee", "unknown"]


def test_buckets(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (4,), (None,)], "n int")
    out = df.select(count_bucket(F.col("n"), 3, "over 3").alias("b"),
                    size_bucket(F.col("n"), ["mono", "one", "two", "three"], "4+").alias("s")).collect()
    assert [r.b for r in out] == ["0", "1", "3", "over 3", "error"]
    assert [r.s for r in out] == ["mono", "one", "three", "4+", "error"]


def test_pair_flag_with_null_keys_and_or_rule(spark):
    df = spark.createDataFrame([("M", "H1", 0), ("M", "H2", 0), (None, "H1", 0), ("S", "X", 1)],
                               "city string, holding string, c2c int")
    pairs = spark.createDataFrame([("M", "H1"), ("M", "H1")], "city string, holding string")
    out = pair_flag(df, pairs, ["city", "holding"], "flag", also=F.col("c2c") == 1)
    got = sorted((r.city or "", r.holding, r.flag) for r in out.collect())
    assert got == [("", "H1", 0), ("M", "H1", 1), ("M", "H2", 0), ("S", "X", 1)]
