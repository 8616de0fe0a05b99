"""Property checks: exact money rounding against Python's Decimal, and the
small ledger / quality operators against hand-computed results."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions.money import avg_money, share_pct
from shelfspark.operators import ledger as L
from shelfspark.operators import quality as Q

cents = st.integers(min_value=-10_000_000, max_value=10_000_000)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(cents, min_size=1, max_size=12), min_size=1, max_size=6))
def test_avg_money_is_exact_half_away_from_zero(spark, groups):
    rows = [(g, Decimal(c).scaleb(-2)) for g, vals in enumerate(groups) for c in vals]
    df = spark.createDataFrame(rows, "g int, v decimal(12,2)")
    got = {r.g: r.a for r in df.groupBy("g").agg(avg_money("v").alias("a")).collect()}
    for g, vals in enumerate(groups):
        mean = Decimal(sum(vals)) / Decimal(len(vals)) / 100
        sign = -1 if mean < 0 else 1
        want = sign * abs(mean).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert got[g] == want, (vals, got[g], want)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=5))
def test_share_pct_is_exact(spark, parts):
    total = sum(parts)
    df = spark.createDataFrame([(p,) for p in parts], "p long")
    got = [r.s for r in df.select(share_pct(F.col("p"), F.lit(total)).alias("s")).collect()]
    for p, s in zip(parts, got):
        if total == 0:
            assert s is None
        else:
            want = (Decimal(p) * 100 / Decimal(total)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
            assert s == want


def test_updates_deletes_and_parent_delete(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, 7, "c")], "k long, q int, t string")
    ch = spark.createDataFrame([(1, 50), (3, None)], "k long, q int")
    got = {r.k: (r.q, r.t) for r in L.apply_updates(base, ch, "k").collect()}
    assert got == {1: (50, "a"), 2: (6, "b"), 3: (7, "c")}
    keys = spark.createDataFrame([(2,)], "k long")
    assert sorted(r.k for r in L.apply_deletes(base, keys, "k").collect()) == [1, 3]
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, parent long")
    gone = spark.createDataFrame([(1,)], "k long")
    nulled = {r.id: r.parent for r in Q.on_parent_delete(child, "parent", gone, "SET NULL").collect()}
    assert nulled == {10: None, 11: 2, 12: None}
    assert [r.id for r in Q.on_parent_delete(child, "parent", gone, "RESTRICT").collect()] == [10]


def test_direct_restock_and_reconcile(spark):
    raw = spark.createDataFrame([("ITM001", "Bag", "N/A", ""), ("ITM002", "Belt", "4", "2025-01-01")],
                                "Item_ID string, Item_Name string, Quantity_In_Stock string, Last_Restocked string")
    rec = spark.createDataFrame([("ITM001", 3, "S", None), ("ITM009", 5, "S", None), ("ITM001", -1, "S", None)],
                                "item_code string, quantity int, supplier_name string, cost_per_unit decimal(10,2)")
    upd, orders = L.direct_restock(raw, rec, dt.date(2026, 1, 17))
    got = {r.Item_ID: (r.Quantity_In_Stock, r.Last_Restocked) for r in upd.collect()}
    assert got == {"ITM001": ("2", "2026-01-17"), "ITM002": ("4", "2025-01-01")}
    assert orders.count() == 2 and {r.Status for r in orders.collect()} == {"Received"}
    opening = spark.createDataFrame([(1, 10), (2, 5)], "item_id long, quantity_in_stock int")
    ledger = spark.createDataFrame([(1, 3, True), (1, 9, False), (2, 5, True)],
                                   "item_id long, quantity_sold int, accepted boolean")
    ords = spark.createDataFrame([(1, "Received", 4), (1, "Pending", 7)],
                                 "item_id long, status string, quantity_ordered int")
    now = spark.createDataFrame([(1, 11), (2, 1)], "item_id long, quantity_in_stock int")
    r = {x.item_id: (x.expected, x.recorded, x.difference) for x in L.reconcile(opening, ledger, ords, now).collect()}
    assert r == {1: (11, 11, 0), 2: (0, 1, 1)}
