"""Report operators on hand-made frames (FIXTURES golden and edge cases)."""

import datetime as dt
from decimal import Decimal as Dec

from shelfspark.operators import raw_reports as RR
from shelfspark.operators import reports as R

AS_OF = dt.date(2026, 1, 17)
INV = ("item_id long, item_code string, item_name string, category string, quantity_in_stock int, "
       "min_stock_level int, cost_price decimal(10,2), selling_price decimal(10,2), profit_margin decimal(10,2), "
       "supplier_id long, date_added date")
SALES = ("transaction_id long, sale_date date, item_id long, quantity_sold int, unit_price decimal(10,2), "
         "total_amount decimal(12,2), payment_method string, sold_by long")


def test_raw_low_stock_alert_and_inventory_value(spark):
    # INVENTORY.csv sample rows (short layout: no Cost_Price column)
    raw = spark.createDataFrame([("ITM001", "Brown Leather Handbag", "20", "35.00", "5"),
                                 ("ITM005", "Black Leather Wallet", "3", "25.00", "5"),
                                 ("ITM009", "Running Shoes", "2", "120.00", "10")],
                                "Item_ID string, Item_Name string, Quantity_In_Stock string, Selling_Price string, "
                                "Min_Stock_Level string")
    alert = [(r.item_id, r.quantity, r.severity) for r in RR.low_stock_alert(raw).collect()]
    assert alert == [("ITM009", 2, "critical"), ("ITM005", 3, "warning")]
    v = RR.raw_inventory_value(raw).first()
    assert (v.total_units, v.unique_items, v.potential_revenue, v.total_cost, v.potential_profit) == \
        (25, 3, Dec("1015.00"), None, None)


def test_raw_low_stock_skips_unparsable_and_default_min(spark):
    raw = spark.createDataFrame([("A", "a", "5.0"), ("B", "b", "4"), ("C", "c", "N/A"), ("D", "d", "9")],
                                "Item_ID string, Item_Name string, Quantity_In_Stock string")
    assert [r.Item_ID for r in RR.raw_low_stock(raw).collect()] == ["B"]


def test_daily_reports_from_raw(spark):
    raw = spark.createDataFrame([
        ("2026-01-17", "ITM001", "Bag", "2", "70.00", "Cash", "T1"),
        ("2026-01-17", "ITM002", "Belt", "2", "10.00", "Card", "T2"),
        ("2026-01-17", "ITM001", "Bag", "", "", "", "T3"),
        ("2026-01-18", "ITM002", "Belt", "1", "5.00", "Cash", "T4"),
    ], "Date string, Item_ID string, Item_Name string, Quantity_Sold string, Total_Amount string, "
       "Payment_Method string, Transaction_ID string")
    h = RR.daily_headline(raw, "2026-01-17").first()
    assert (h.total_revenue, h.transactions, h.items_sold) == (Dec("80.00"), 3, 4)
    mix = {r.Payment_Method: (r.transactions, r.amount) for r in RR.daily_payment_mix(raw, "2026-01-17").collect()}
    assert mix == {"Cash": (1, Dec("70.00")), "Card": (1, Dec("10.00"))}
    best = RR.daily_best_seller(raw, "2026-01-17").first()
    # tie on quantity (2 and 2): the item seen first wins, whatever its revenue
    assert (best.best_seller, best.quantity, best.revenue) == ("Bag", 2, Dec("70.00"))


def _inv(spark, rows):
    return spark.createDataFrame(rows, INV)


def test_payment_shares(spark):
    one = spark.createDataFrame([(1, AS_OF, 1, 1, Dec("5.00"), Dec("5.00"), "Cash", 1)], SALES)
    assert R.payment_summary(one).first().revenue_percentage == Dec("100.00")
    three = spark.createDataFrame([(i, AS_OF, 1, 1, Dec("5.00"), Dec("5.00"), m, 1)
                                   for i, m in enumerate(["Cash", "Card", "Other"])], SALES)
    assert {r.revenue_percentage for r in R.payment_summary(three).collect()} == {Dec("33.33")}


def test_supplier_fan_out(spark):
    sup = spark.createDataFrame([(1, "SUP001", "S", None, None)],
                                "supplier_id long, supplier_code string, supplier_name string, contact_person string, "
                                "phone string")
    inv = _inv(spark, [(i, f"ITM{i}", "x", "Bags", 2, 5, Dec("1.00"), Dec("2.00"), Dec("1.00"), 1, AS_OF)
                       for i in range(3)])
    o = spark.createDataFrame([(10, 1, "Received", Dec("4.00")), (11, 1, "Pending", Dec("3.00"))],
                              "order_id long, supplier_id long, status string, total_cost decimal(12,2)")
    lit = R.supplier_performance(sup, inv, o).first()
    assert (lit.items_supplied, lit.total_orders, lit.completed_orders, lit.total_spent,
            lit.current_stock_from_supplier) == (3, 6, 3, Dec("12.00"), 12)
    true = R.supplier_performance(sup, inv, o, fan_out=False).first()
    assert (true.total_orders, true.total_spent, true.current_stock_from_supplier) == (2, Dec("4.00"), 6)


def test_slow_movers_and_category(spark):
    inv = _inv(spark, [
        (1, "A", "never", "Bags", 3, 5, Dec("1.00"), Dec("2.00"), Dec("1.00"), None, dt.date(2025, 1, 1)),
        (2, "B", "four", "Bags", 3, 5, Dec("1.00"), Dec("2.00"), Dec("1.00"), None, dt.date(2025, 1, 1)),
        (3, "C", "five", "Shoes", 3, 5, Dec("1.00"), Dec("2.00"), Dec("1.00"), None, dt.date(2025, 1, 1)),
        (4, "D", "today", "Belts", 3, 5, Dec("1.00"), Dec("2.00"), Dec("1.00"), None, AS_OF),
    ])
    sales = spark.createDataFrame([(1, AS_OF, 2, 4, Dec("2.00"), Dec("8.00"), "Cash", 1),
                                   (2, AS_OF, 3, 5, Dec("2.00"), Dec("10.00"), "Cash", 1)], SALES)
    slow = {r.item_code: (r.total_sold, r.avg_daily_sales) for r in R.slow_movers(inv, sales, AS_OF).collect()}
    assert slow == {"A": (0, Dec("0.00")), "B": (4, Dec("0.01")), "D": (0, Dec("0.00"))}
    cat = {r.category: (r.total_items, r.total_revenue, r.current_stock_units)
           for r in R.category_performance(inv, sales).collect()}
    assert cat["Belts"] == (1, None, 3) and cat["Bags"] == (2, Dec("8.00"), 6)


def test_restock_status_labels(spark):
    o = spark.createDataFrame([
        ("P1", 1, 1, "Pending", AS_OF - dt.timedelta(days=1)), ("P2", 1, 1, "Pending", AS_OF),
        ("P3", 1, 1, "Pending", AS_OF + dt.timedelta(days=1)), ("P4", 1, 1, "Pending", None),
        ("P5", 1, 1, "Received", AS_OF)],
        "order_code string, supplier_id long, item_id long, status string, expected_delivery date").selectExpr(
        "*", "date'2026-01-01' AS date_ordered", "1 AS quantity_ordered", "CAST(1 AS DECIMAL(10,2)) AS cost_per_unit",
        "CAST(1 AS DECIMAL(12,2)) AS total_cost")
    sup = spark.createDataFrame([(1, "S")], "supplier_id long, supplier_name string")
    inv = spark.createDataFrame([(1, "ITM1", "x")], "item_id long, item_code string, item_name string")
    got = {r.order_code: r.delivery_status for r in R.restock_status(o, sup, inv, AS_OF).collect()}
    assert got == {"P1": "OVERDUE", "P2": "DUE TODAY", "P3": "ON TIME", "P4": "ON TIME", "P5": "Received"}


def test_empty_inputs(spark):
    inv = _inv(spark, [])
    t = R.inventory_totals(inv).first()
    assert (t.total_cost_value, t.total_selling_value, t.potential_profit) == (None, None, None)
    s = R.sales_range_summary(spark.createDataFrame([], SALES), AS_OF, AS_OF).first()
    assert (s.total_transactions, s.total_items_sold, s.total_revenue, s.avg_transaction_value) == (0, None, None, None)
