import math

import pytest
from pyspark.sql import functions as F

from backlist.functions import (
    NA_WORDS, null_words, parse_date, parse_money, parse_number, parse_quantity, money_text,
    pct_text, round_half_even, tidy_name,
)

# money cell -> value (pandas semantics after the scrub)
MONEY = [
    ("$1,234.50", 1234.5), ("(500)", -500.0), ("$ (1,000) ", -1000.0), ("-", 0.0), ("nan", 0.0),
    ("inf", math.inf), ("1.5d", 0.0), ("2f", 0.0), ("1e3", 1000.0), ("", 0.0), (" 7\t", 7.0),
    ("abc", 0.0), ("--5", 0.0), ("+3", 3.0), ("1_000", 0.0), ("0x10", 0.0), ("0x1p3", 0.0),
    ("1e400", 0.0), (".5", 0.5), ("5.", 5.0), ("(-5)", 0.0), (None, 0.0), ("-inf", -math.inf),
    ("12.25", 12.25), ("$-3", -3.0),
]


def _one(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_parse_money_hostile(spark):
    got = _one(spark, [m for m, _ in MONEY], parse_money)
    for (text, want), g in zip(MONEY, got):
        assert g == want, (text, g, want)


def test_parse_quantity_no_scrub(spark):
    cases = [("1,200", 0.0), ("25", 25.0), (" 7\t", 7.0), ("nan", 0.0), ("$5", 0.0), (None, 0.0),
             ("3d", 0.0), ("1e2", 100.0)]
    got = _one(spark, [c for c, _ in cases], parse_quantity)
    assert got == [w for _, w in cases]


def test_parse_number_keeps_missing(spark):
    got = _one(spark, ["2020", "nan", None, "x", "2019.0"], parse_number)
    assert got[0] == 2020.0 and got[1] is None and got[2] is None and got[3] is None and got[4] == 2019.0


def test_null_words_exact_match_only(spark):
    values = list(NA_WORDS) + [" NA", "-", "NA "]
    got = _one(spark, values, null_words)
    assert got[: len(NA_WORDS)] == [None] * len(NA_WORDS)
    assert got[len(NA_WORDS):] == [" NA", "-", "NA "]


def test_parse_date_formats_and_junk(spark):
    import datetime as dt
    got = _one(spark, ["2020-01-15", "3/22/2021", "2019/11/08", "bad", "", None, "2021-02-30"], parse_date)
    assert got[:3] == [dt.date(2020, 1, 15), dt.date(2021, 3, 22), dt.date(2019, 11, 8)]
    assert got[3:] == [None, None, None, None]


def test_numpy_rounding_and_text(spark):
    df = spark.createDataFrame([(1.005,), (1.015,), (0.125,), (2.5,), (-1234.6,), (12.25,)], "x double")
    r = df.select(round_half_even(F.col("x"), 2).alias("r"), money_text(F.col("x")).alias("m"),
                  pct_text(F.col("x")).alias("p")).collect()
    # numpy: round(1.005, 2) == 1.0, round(1.015, 2) == 1.01, round(0.125, 2) == 0.12
    import numpy as np
    assert [x.r for x in r] == [float(np.round(v, 2)) for v in (1.005, 1.015, 0.125, 2.5, -1234.6, 12.25)]
    assert r[3].m == "$2" and r[4].m == "$-1,235"
    assert r[5].p == "+12.2%"


def test_tidy_name(spark):
    got = _one(spark, ["exponential_smoothing", "linear"], tidy_name)
    assert got == ["Exponential Smoothing", "Linear"]


def test_sql_forms_equal_the_column_forms(spark):
    from pyspark.sql import functions as F

    from backlist.functions import clean
    cells = ["$1,234.50", "(500)", "$ (1,000) ", "-", "abc", "nan", "1e3", "1.5d", "1e999", "inf", "-Infinity", " 7 ", "", "NULL",
             "#N/A", "<NA>", "0x1p3", "1,200", ".5", "5.", "--5", "\\d", None]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    got = df.select("t", F.expr(clean.null_words_sql("t")).alias("a"), clean.null_words("t").alias("a2"),
                    F.expr(clean.parse_money_sql("t")).alias("b"), clean.parse_money("t").alias("b2"),
                    F.expr(clean.parse_quantity_sql("t")).alias("c"), clean.parse_quantity("t").alias("c2"),
                    F.expr(clean.not_money_sql("t")).alias("d")).collect()
    for r in got:
        assert (r.a, r.b, r.c) == (r.a2, r.b2, r.c2), r
    assert {r.t for r in got if r.d} == {"-", "abc", "nan", "1.5d", "1e999", "", "NULL", "#N/A", "<NA>", "0x1p3", "--5", "\\d"}
