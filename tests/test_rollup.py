"""Sales roll-up by next day: periods and ranges equal to the reports over the sales."""

import datetime as dt
import random

from shelfspark.operators import reports as R
from shelfspark.operators import rollup as RU

D = dt.date(2025, 12, 20)
SALES = "transaction_id long, item_id long, sale_date date, quantity_sold int, total_amount decimal(10,2), note string"


def _sales(spark, n=400):
    rnd = random.Random(3)
    rows = []
    for _ in range(n):
        day = None if rnd.random() < 0.05 else D + dt.timedelta(days=rnd.randrange(50))
        txn = None if rnd.random() < 0.05 else rnd.randrange(60) + (1 << 60)
        item = 1 if rnd.random() < 0.4 else rnd.choice([None, *range(2, 9)])
        rows.append((txn, item, day, rnd.choice([None, 1, 5]), rnd.choice([None, round(rnd.random() * 50, 2)]), "x"))
    rows = [(*r[:4], None if r[4] is None else __import__("decimal").Decimal(str(r[4])), r[5]) for r in rows]
    return spark.createDataFrame(rows + rows[:20], SALES), rows + rows[:20]


def test_grains_equal_the_reports(spark):
    sales, _ = _sales(spark)
    rollup = RU.sales_rollup(sales)
    assert rollup.count() <= 51 * 52 // 2
    for grain in ("day", "week", "month"):
        want, got = R.sales_summary(sales, grain), RU.summary(rollup, grain)
        assert got.columns == want.columns
        assert got.collect() == want.collect()


def test_text_keys(spark):
    sales, _ = _sales(spark, 60)
    text = sales.withColumn("transaction_id", sales.transaction_id.cast("string"))
    assert RU.summary(RU.sales_rollup(text), "week").collect() == R.sales_summary(sales, "week").collect()


def test_every_range(spark):
    sales, rows = _sales(spark)
    days = [D + dt.timedelta(days=k) for k in range(-2, 53, 5)]
    ranges = [(a, b) for a in days for b in days] + [(D, None), (None, D), (D, D), (D, D)]
    got = {(r.range_start, r.range_end): r for r in RU.range_summaries(
        RU.sales_rollup(sales), spark.createDataFrame(ranges, "range_start date, range_end date")).collect()}
    assert set(got) == set(ranges)
    for (a, b), r in got.items():
        inside = [s for s in rows if a and b and s[2] and a <= s[2] <= b]
        assert r.total_transactions == len({s[0] for s in inside} - {None})
        assert r.unique_items_sold == len({s[1] for s in inside} - {None})
        assert r.total_revenue == (sum(s[4] for s in inside if s[4] is not None) if any(s[4] is not None for s in inside) else None)
    one = R.sales_range_summary(sales, days[1], days[6]).first()
    mine = got[days[1], days[6]]
    assert all(one[c] == mine[c] for c in one.asDict())


def test_empty(spark):
    rollup = RU.sales_rollup(spark.createDataFrame([], SALES))
    assert rollup.count() == 0 and RU.summary(rollup, "month").count() == 0
    r = RU.range_summaries(rollup, spark.createDataFrame([(D, D)], "range_start date, range_end date")).first()
    assert (r.total_transactions, r.total_items_sold) == (0, None)
