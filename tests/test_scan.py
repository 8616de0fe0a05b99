import random

import pandas as pd
from pyspark.sql import functions as F

from shelfspark.functions.scan import range_sorted, running_total, with_previous


def _data(n=3000, seed=7):
    rnd = random.Random(seed)
    # key 1 holds about a third of all rows (hot key spanning partitions)
    return [(1 if rnd.random() < 0.34 else rnd.randint(2, 40), i, rnd.randint(0, 9)) for i in range(n)]


def test_running_total_matches_pandas_with_hot_key(spark):
    data = _data()
    df = spark.createDataFrame(data, "k long, t long, v long")
    out = running_total(df, ["k"], ["t"], "v", "cum", partitions=7)
    got = {(r.k, r.t): r.cum for r in out.collect()}
    pdf = pd.DataFrame(data, columns=["k", "t", "v"]).sort_values(["k", "t"])
    pdf["cum"] = pdf.groupby("k")["v"].cumsum()
    assert got == {(k, t): c for k, t, c in zip(pdf.k, pdf.t, pdf.cum)}
    # the hot key really spans several partitions
    assert out.where(F.col("k") == 1).select("_pid").distinct().count() > 1


def test_running_max_and_previous(spark):
    data = _data(1500, 3)
    df = spark.createDataFrame(data, "k long, t long, v long").withColumn(
        "m", F.when(F.col("v") > 6, F.col("t")))
    out = running_total(df, ["k"], ["t"], "m", "mx", partitions=5, op="max")
    pdf = pd.DataFrame(data, columns=["k", "t", "v"]).sort_values(["k", "t"])
    pdf["m"] = pdf.t.where(pdf.v > 6)
    pdf["mx"] = pdf.groupby("k")["m"].cummax()
    pdf["mx"] = pdf.groupby("k")["mx"].ffill()
    want = {(k, t): (None if pd.isna(m) else int(m)) for k, t, m in zip(pdf.k, pdf.t, pdf.mx)}
    assert {(r.k, r.t): r.mx for r in out.collect()} == want

    parts = range_sorted(df.select("k", "t"), ["k", "t"], partitions=5)
    prev = with_previous(parts, ["k"], ["t"], "t", "p")
    pdf["p"] = pdf.groupby("k")["t"].shift()
    want_p = {(k, t): (None if pd.isna(p) else int(p)) for k, t, p in zip(pdf.k, pdf.t, pdf.p)}
    assert {(r.k, r.t): r.p for r in prev.collect()} == want_p
