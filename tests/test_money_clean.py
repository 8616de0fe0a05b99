import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shelfspark.functions.clean import clean_date, clean_int, clean_money
from shelfspark.functions.money import avg_money, ratio_2dp, share_pct


def test_avg_money_rounds_ties_away_from_zero(spark):
    df = spark.createDataFrame([("a", "1.01"), ("a", "1.02"), ("b", "-1.01"), ("b", "-1.02"), ("c", None)],
                               "k string, v string").select("k", F.col("v").cast("decimal(10,2)").alias("v"))
    got = {r.k: r.a for r in df.groupBy("k").agg(avg_money("v").alias("a")).collect()}
    assert got == {"a": Decimal("1.02"), "b": Decimal("-1.02"), "c": None}


def test_share_and_ratio(spark):
    r = spark.range(1).select(
        share_pct(F.lit(1), F.lit(3)).alias("third"), share_pct(F.lit(5), F.lit(5)).alias("all"),
        ratio_2dp(F.lit(7), F.lit(2)).alias("r"), ratio_2dp(F.lit(1), F.lit(0)).alias("zero")).first()
    assert (r.third, r.all, r.r, r.zero) == (Decimal("33.33"), Decimal("100.00"), Decimal("3.50"), None)


def test_clean_money_and_int(spark):
    cases = {
        "$1,234.50": (Decimal("1234.50"), 0), "฿99": (Decimal("99.00"), 0), "": (Decimal("0.00"), 0),
        None: (Decimal("0.00"), 0), "abc": (Decimal("0.00"), 0), "(5.00)": (Decimal("0.00"), 0),
        "nan": (Decimal("0.00"), 0), "5.0": (Decimal("5.00"), 5), "5.9": (Decimal("5.90"), 5),
        "-1.5": (Decimal("-1.50"), -1), "1,000": (Decimal("1000.00"), 0), "1e3": (Decimal("1000.00"), 1000),
        "inf": (Decimal("0.00"), 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: (r.m, r.i) for r in df.select("v", clean_money("v").alias("m"), clean_int("v").alias("i")).collect()}
    assert got == cases


def test_clean_date_patterns_in_order(spark):
    cases = {
        "2026-1-5": dt.date(2026, 1, 5), "03/04/2026": dt.date(2026, 3, 4), "13/04/2026": dt.date(2026, 4, 13),
        "2026/02/30": None, "5-JAN-2026": dt.date(2026, 1, 5), "N/A": None, "1/2/26": None, "": None,
        "2026/2/3": dt.date(2026, 2, 3),
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.d for r in df.select("v", clean_date("v").alias("d")).collect()}
    assert got == cases
