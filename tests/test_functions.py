import datetime as dt

from pyspark.sql import functions as F

from tallyspark.functions import (
    concat_skip_nulls,
    fold_homoglyphs,
    iso_week,
    iso_year,
    last_week_end,
    like_any,
    occurrences,
    parse_invoice_datetime,
    rtrim_chars,
    surrogate_key,
    weekday_sun1,
    yyyy_mm_label,
)
from tallyspark.functions.keys import NULL_TOKEN
from tallyspark.functions.text import fold_literal


def test_homoglyph_fold_matches_both_alphabets(spark):
    df = spark.createDataFrame([("А342",), ("A342",), ("x",), (None,)], "c string")  # Cyrillic А, Latin A
    out = df.select(fold_homoglyphs(F.col("c")).contains(fold_literal("А342")).alias("m")).collect()
    assert [r.m for r in out] == [True, True, False, None]


def test_like_any_null_and_prefix(spark):
    df = spark.createDataFrame([("KiaRio",), ("Volvo",), (None,)], "c string")
    out = [r.m for r in df.select(like_any(F.col("c"), ["Kia%", "Lada%"]).alias("m")).collect()]
    assert out == [True, False, None]


def test_occurrences_and_concat_and_rtrim(spark):
    df = spark.createDataFrame([("A&B&C", None, "x&&")], "s string, n string, t string")
    r = df.select(occurrences(F.col("s"), "&").alias("o"), concat_skip_nulls(F.col("s"), F.col("n")).alias("c"),
                  rtrim_chars(F.col("t"), "&").alias("t")).first()
    assert (r.o, r.c, r.t) == (2, "A&B&C", "x")


def test_calendar_labels(spark):
    days = [dt.date(2018, 5, 3), dt.date(2021, 1, 1), dt.date(2020, 12, 31), dt.date(2019, 12, 30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select(yyyy_mm_label("d").alias("ym"), iso_week("d").alias("w"), iso_year("d").alias("y"),
                     weekday_sun1("d").alias("wd"), last_week_end("d").alias("sat"),
                     last_week_end("d", 1).alias("sun")).collect()
    for d, r in zip(days, rows):
        y, w, _ = d.isocalendar()
        assert r.ym == f"{d.year}_{d.month:02d}"
        assert (r.y, r.w) == (y, w)
        assert r.wd == d.isoweekday() % 7 + 1
        assert r.sat.weekday() == 5 and r.sat < d + dt.timedelta(days=1)
        assert r.sun.weekday() == 6


def test_parse_invoice_datetime_forms(spark):
    texts = ["12/1/2010 8:26", "12/01/2010 08:26", "1/5/11 9:05", "1/5/99 9:05", "13/1/2010 8:26", "bad", None,
             "12/1/10 18:26"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.p for r in df.select(parse_invoice_datetime(F.col("s")).alias("p")).collect()]
    assert got[0] == dt.datetime(2010, 12, 1, 8, 26)      # 14 chars, 4-digit year (length rule would fail)
    assert got[1] == dt.datetime(2010, 12, 1, 8, 26)
    assert got[2] == dt.datetime(2011, 1, 5, 9, 5)
    assert got[3] == dt.datetime(1999, 1, 5, 9, 5)        # pivot: 99 -> 1999, not 2099
    assert got[4] is None and got[5] is None and got[6] is None
    assert got[7] == dt.datetime(2010, 12, 1, 18, 26)
    strict = [r.p for r in df.select(parse_invoice_datetime(F.col("s"), strict_lengths=True).alias("p")).collect()]
    assert strict[0] is None and strict[1] is not None and strict[2] is not None


def test_surrogate_key_null_token_and_doubles(spark):
    df = spark.createDataFrame([(12345.0, "X"), (None, "X"), (1e7, None)], "a double, b string")
    keys = [r.k for r in df.select(surrogate_key(df, ["a", "b"]).alias("k")).collect()]
    import hashlib

    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()

    assert keys[0] == md5("12345.0000-X")
    assert keys[1] == md5(f"{NULL_TOKEN}-X")
    assert keys[2] == md5(f"10000000.0000-{NULL_TOKEN}")


def test_reference_builtin_scalars(spark):
    """Built-ins used as the reference uses them (substring/position, replace, ltrim, intervals, ceil-free trunc)."""
    df = spark.createDataFrame([("23 abc", "A&&B&", " 7", dt.date(2022, 3, 31), -2.7)],
                               "s string, g string, p string, d date, x double")
    r = df.select(
        F.expr("substring(s, 1, locate(' ', s))").alias("wk"),
        F.expr("substring(s, locate(' ', s) + 1, 100)").alias("rest"),
        F.replace(F.col("g"), F.lit("&&"), F.lit("")).alias("rep"),
        F.ltrim("p").alias("lt"),
        F.expr("d - INTERVAL 1 MONTH").alias("prev"),
        F.expr("upper('тольятти')").alias("up"),
    ).first()
    assert (r.wk, r.rest, r.rep, r.lt) == ("23 ", "abc", "AB&", "7")
    assert r.prev == dt.date(2022, 2, 28) and r.up == "ТОЛЬЯТТИ"
    from tallyspark.functions import trunc0
    assert df.select(trunc0(F.col("x")).alias("t")).first().t == -2


def test_fifteen_character_dates(spark):
    """A 15-character text parses under the default rule and is NULL under the length rule."""
    df = spark.createDataFrame([("12/1/2010 18:26",)], "s string")
    assert len("12/1/2010 18:26") == 15
    r = df.select(parse_invoice_datetime(F.col("s")).alias("lenient"),
                  parse_invoice_datetime(F.col("s"), strict_lengths=True).alias("strict")).first()
    assert r.lenient == dt.datetime(2010, 12, 1, 18, 26) and r.strict is None


def test_numeric_and_key_helpers(spark):
    from decimal import Decimal

    from tallyspark.functions import key_text, money, month_back, ratio, round_ratio
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1234.565, 3.0, 0.0, dt.date(2020, 3, 31))], "x double, a double, z double, d date")
    r = df.select(money("x").alias("m"), ratio(F.col("a"), F.col("z")).alias("r0"),
                  round_ratio(F.col("a"), F.lit(7.0), 3).alias("r"), month_back("d").alias("mb"),
                  key_text(F.col("x"), T.DoubleType()).alias("kt")).first()
    assert isinstance(r.m, Decimal) and r.r0 is None and r.r == 0.429 and r.mb == dt.date(2020, 2, 29)
    assert r.kt == "1234.5650"
