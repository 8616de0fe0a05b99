"""Ingest (ETL-3..6, JOI-7) and access (FLT-1/8/9, PRJ, WIN-2) edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from shelfspark.operators import access as X
from shelfspark.operators import etl as E

AS_OF = dt.date(2026, 1, 17)


def test_assign_codes_global_and_per_day(spark):
    existing = spark.createDataFrame([("ITM999",), ("ITMX",)], "item_code string")
    rows = spark.createDataFrame([("", "b"), ("ITM005", "a"), ("", "a")], "item_code string, _seq string")
    got = {r._seq + ("*" if r.item_code != "ITM005" else ""): r.item_code
           for r in E.assign_codes(rows, "item_code", existing, "ITM", ["_seq"]).collect()}
    assert got == {"a": "ITM005", "a*": "ITM1000", "b*": "ITM1001"}
    empty = spark.createDataFrame([], "item_code string")
    one = spark.createDataFrame([("", "z")], "item_code string, _seq string")
    assert E.assign_codes(one, "item_code", empty, "ITM", ["_seq"]).first().item_code == "ITM001"
    tx = spark.createDataFrame([("", i) for i in range(12)], "transaction_code string, n int")
    ex = spark.createDataFrame([("TXN20260117-004",)], "transaction_code string")
    codes = sorted(r.transaction_code for r in
                   E.assign_codes(tx, "transaction_code", ex, "TXN", ["n"], day=F.lit(AS_OF)).collect())
    assert codes[0] == "TXN20260117-005" and codes[-1] == "TXN20260117-016"


def test_load_sales_lookups_and_rejects(spark):
    inv = spark.createDataFrame([("ITM001", "Bag", "ITM001"), ("ITM002", "Belt", "ITM002"), ("ITM003", "Belt", "ITM003")],
                                "item_code string, item_name string, _seq string").withColumn("item_id", F.col("item_code"))
    usr = spark.createDataFrame([("USR001", "ann", "USR001")], "user_code string, username string, _seq string") \
        .withColumn("user_id", F.col("user_code"))
    raw = spark.createDataFrame([
        ("T1", "2026-01-17", "10:00:00", "ITM009", "Bag", "2", "$35.00", "Cash", "ann"),     # by name
        ("T2", "03/04/2026", "10:00:00", "", "Belt", "1", "5", "Card", "USR001"),           # later dup wins
        ("T3", "", "10:00:00", "", "Nothing", "1", "5", "Cash", ""),                        # no item
        ("T4", "2026-01-17", "10:00:00", "ITM001", "Bag", "0", "5", "Cash", ""),            # qty 0
        ("T5", "2026-01-17", "10:00:00", "ITM001", "Bag", "1", "5", "", ""),                # blank payment
    ], "Transaction_ID string, Date string, Time string, Item_ID string, Item_Name string, Quantity_Sold string, "
       "Unit_Price string, Payment_Method string, Sold_By string")
    good, bad = E.load_sales(raw, inv, usr, AS_OF)
    g = {r.transaction_code: (r.item_id, r.sale_date, str(r.unit_price), r.sold_by) for r in good.collect()}
    assert g == {"T1": ("ITM001", AS_OF, "35.00", "USR001"), "T2": ("ITM003", dt.date(2026, 3, 4), "5.00", "USR001")}
    b = {r.Transaction_ID: r.reject_reason for r in bad.collect()}
    assert b == {"T3": "item not found", "T4": "invalid quantity", "T5": "invalid payment method"}


def test_defaults_only_when_column_absent(spark):
    sup = spark.createDataFrame([], "supplier_id string, supplier_code string, supplier_name string, _seq string")
    raw = spark.createDataFrame([("ITM001", "Bag", "3")], "Item_ID string, Item_Name string, Quantity_In_Stock string")
    inv, bad = E.load_inventory(raw, sup, AS_OF)
    r = inv.first()
    assert (r.category, r.min_stock_level, r.quantity_in_stock, r.date_added) == ("Other", 5, 3, AS_OF)
    raw2 = raw.withColumn("Category", F.lit(""))
    _, bad2 = E.load_inventory(raw2, sup, AS_OF)
    assert bad2.first().reject_reason == "invalid category"


def test_username_conflicts_case_insensitive(spark):
    usr = spark.createDataFrame([("Ann",)], "username string")
    new = spark.createDataFrame([("ann",), ("Bob",), ("BOB",)], "username string")
    got = {(r.username, r.conflict) for r in E.username_conflicts(new, usr).collect()}
    assert got == {("ann", "exists"), ("Bob", "duplicate in batch"), ("BOB", "duplicate in batch")}


def test_search_and_visibility(spark):
    inv = spark.createDataFrame([("ITM001", "Red 50% Bag", "Bags", "Acme"), ("ITM002", "Belt_x", None, "Unknown")],
                                "item_code string, item_name string, category string, supplier_name string")
    assert X.search_items(inv, "50%").count() == 1
    assert X.search_items(inv, "_").count() == 1
    assert X.search_items(inv, "BAG").count() == 1
    assert X.search_items(inv, "").count() == 2
    assert X.search_items(inv, "none").count() == 0
    usr = spark.createDataFrame([(1, "Admin"), (2, "Staff")], "user_id long, role string")
    log = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "log_id long, user_id long")
    assert X.visible_rows(log, "activity_log", usr, 1).count() == 3
    assert X.visible_rows(log, "activity_log", usr, 2).count() == 2
    assert X.visible_rows(log, "activity_log", usr, 9).count() == 0
    assert X.visible_rows(log, "sales_log", usr, 2).count() == 3
    counts = {r.user_id: r.visible_rows for r in X.visible_counts(log, "activity_log", usr).collect()}
    assert counts == {1: 3, 2: 2}
    req = spark.createDataFrame([(1, "delete_item"), (2, "delete_item"), (2, "restock"), (9, "restock")],
                                "user_id long, permission string")
    ok = {(r.user_id, r.permission): r.allowed for r in X.allowed(req, usr, X.permission_table(spark)).collect()}
    assert ok == {(1, "delete_item"): True, (2, "delete_item"): False, (2, "restock"): True, (9, "restock"): False}


def test_legacy_names_and_dedup(spark):
    inv = spark.createDataFrame([(1, "ITM001", "x")], "item_id long, item_code string, item_name string")
    assert X.to_legacy(inv).columns == ["_uuid", "Item_ID", "Item_Name"]
    assert X.from_legacy(X.to_legacy(inv)).columns == inv.columns
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), ("j", 1, "only")],
                               "key string, ts int, v string")
    assert {(r.key, r.v) for r in X.dedup_latest(df, "key", "ts").collect()} == {("k", "new"), ("j", "only")}


def test_generated_columns(spark):
    from decimal import Decimal
    inv = spark.createDataFrame([(Decimal("3.50"), Decimal("5.00"))], "cost_price decimal(10,2), selling_price decimal(10,2)")
    assert X.with_generated(inv, "inventory").first().profit_margin == Decimal("1.50")
    s = spark.createDataFrame([(3, Decimal("2.25"))], "quantity_sold int, unit_price decimal(10,2)")
    assert X.with_generated(s, "sales_log").first().total_amount == Decimal("6.75")


def test_load_users_keeps_last_login(spark):
    raw = spark.createDataFrame([("USR001", "ann", "2026-01-17 08:30:00"), ("USR002", "bob", "")],
                                "User_ID string, Username string, Last_Login string")
    users, bad = E.load_users(raw)
    got = {r.username: r.last_login for r in users.collect()}
    assert got == {"ann": dt.datetime(2026, 1, 17, 8, 30), "bob": None} and bad.count() == 0


def test_loader_codes_continue_and_repeats_are_rejected(spark):
    """Blank codes are numbered after the batch and the target; a repeated code keeps its first row."""
    from shelfspark.operators import etl as E

    raw = spark.createDataFrame(
        [("ITM001", "a"), ("ITM002", "b"), ("", "c"), ("ITM002", "d"), ("ITM2000", "e"), ("ITM999", "e")],
        "Item_ID string, Item_Name string").selectExpr(
        "Item_ID", "Item_Name", "'Bags' AS Category", "'1' AS Quantity_In_Stock", "'1' AS Cost_Price", "'1' AS Selling_Price")
    sup = spark.createDataFrame([], "supplier_id string, supplier_code string, supplier_name string, _seq string")
    target = spark.createDataFrame([("ITM3000",)], "item_code string")
    good, bad = E.load_inventory(raw, sup, dt.date(2026, 1, 1), existing=target)
    got = {r.item_name: r.item_code for r in good.collect() if r.item_name != "e"}
    assert got["a"] == "ITM001" and got["c"] == "ITM3001" and len(got) == 3
    assert [(r.Item_ID, r.reject_reason) for r in bad.collect()] == [("ITM002", "duplicate code")]
    keys = {r._k: r._id for r in E.key_table(good, "item_id", ["item_name"], "_seq").collect()}
    assert keys["e"] == "ITM2000"  # the later number wins, not the later text


def test_csv_cells_round_trip(spark, tmp_path):
    """Quotes, commas, line ends and blanks in a cell survive; a standard reader agrees."""
    import csv
    import glob

    from shelfspark.sources import io

    cells = [('say "hi", ok', "x"), ("two\nlines", " padded "), ("plain", "")]
    df = spark.createDataFrame(cells, "A string, B string").coalesce(1)
    base = io.export_snapshot({"T": df}, str(tmp_path), dt.datetime(2026, 1, 1))
    assert sorted(tuple(r) for r in io.read_raw(spark, f"{base}/T").collect()) == sorted(cells)
    with open(glob.glob(f"{base}/T/part-*")[0], newline="", encoding="utf-8") as f:
        assert sorted(tuple(r) for r in list(csv.reader(f))[1:]) == sorted(cells)


def test_conflicting_updates(spark):
    import pytest

    from shelfspark.operators import ledger as L

    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, name string, n int")
    changes = spark.createDataFrame([(1, "x", None, 1), (1, "y", 9, 2), (1, None, 8, 3)], "k long, name string, n int, at int")
    assert sorted(tuple(r) for r in L.apply_updates(base, changes, "k", order="at").collect()) == [(1, "y", 8), (2, "b", 6)]
    with pytest.raises(Exception, match="several changes"):
        L.apply_updates(base, changes.drop("at"), "k").collect()


def test_loaders_shuffle_rows_once_a_lookup_and_once_for_repeats(spark):
    """Repeats cost no second reading of the input, and a fallback lookup moves the rows that need it only."""
    inv = spark.createDataFrame([("ITM001", "Bag", "ITM001"), ("ITM002", "Belt", "ITM002")],
                                "item_code string, item_name string, _seq string").withColumn("item_id", F.col("item_code"))
    usr = spark.createDataFrame([("USR001", "ann", "USR001")], "user_code string, username string, _seq string") \
        .withColumn("user_id", F.col("user_code"))
    raw = spark.createDataFrame(
        [("T1", "2026-01-17", f"{10 + n % 9}:00:00", "ITM001", "Bag", str(n % 3), "5", "Cash", "ann") for n in range(60)]
        + [("T2", "2026-01-17", "10:00:00", "gone", "Belt", "1", "5", "Cash", "nobody")] * 2
        + [("T3", "2026-01-17", "10:00:00", "ITM002", "Bag", "1", "5", "Cash", None)]
        + [(c, "2026-01-17", "10:00:00", "", "Belt", "1", "5", "Cash", "") for c in ("", "", None)],
        "Transaction_ID string, Date string, Time string, Item_ID string, Item_Name string, Quantity_Sold string, "
        "Unit_Price string, Payment_Method string, Sold_By string")
    good, bad = E.load_sales(raw, inv, usr, AS_OF)
    got = sorted((r.transaction_code, r.sale_time, r.item_id, r.quantity_sold, r.sold_by) for r in good.collect())
    assert [g for g in got if g[0] in ("T1", "T2", "T3")] == [
        ("T1", "11:00:00", "ITM001", 1, "USR001"), ("T2", "10:00:00", "ITM002", 1, None), ("T3", "10:00:00", "ITM002", 1, None)]
    assert len(got) == 6 and len({g[0] for g in got}) == 6  # blank codes are numbered, not repeats
    why = {(r.Transaction_ID, r.reject_reason): r["count"] for r in bad.groupBy("Transaction_ID", "reject_reason").count().collect()}
    assert why == {("T1", "invalid quantity"): 20, ("T1", "duplicate code"): 39, ("T2", "duplicate code"): 1}
    rows = raw.where("Transaction_ID <> ''")
    plan = E.load_sales(rows, inv, usr, AS_OF)[0]._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan and "WindowGroupLimit" in plan
