"""Reporting views (REP-1..12) and table functions (AGG-1..3).

Plan shapes, chosen for a fact table (sales, orders) that is orders of
magnitude bigger than the dimensions (items, suppliers, users):

* Facts are rolled up to the join grain *before* joining (AGG-10), so the
  shuffle carries one partial row per key per task (map-side combine),
  and a hot key costs one row per task, not a third of the table.
* The fan-out of the reference views (category and supplier reports sum
  dimension columns once per joined fact row) is reproduced algebraically
  from per-key counts (`fan_out=True`), never by materialising the
  cross product. `fan_out=False` gives the true figures.
* No broadcast hints: dimensions grow with the data, so the choice is left
  to Spark's size-checked auto-broadcast and AQE's runtime statistics.
* Money stays decimal; averages and shares round exactly
  (`shelfspark.functions.money`).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.money import (
    avg_money,
    avg_money_from,
    cents,
    ratio_2dp,
    round_ratio,
    share_pct,
)

SUM_T = "decimal(38,2)"
AVG_T = "decimal(18,2)"


def _sum_money(c: Column) -> Column:
    return F.sum(c).cast(SUM_T)


# ---------------------------------------------------------------------------
# AGG-10: item-grain sales rollup shared by REP-6/7/8.
# ---------------------------------------------------------------------------
def item_sales_rollup(sales: DataFrame) -> DataFrame:
    """One row per sold item_id: row count, counts and sums needed above.

    Σ qty*(price - cost) is later computed as Σ qty*price - cost*Σ qty,
    exact in decimals, so the item's cost is not needed before the join.
    """
    return sales.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("transaction_id").alias("n_txn"),
        F.sum("quantity_sold").alias("sum_qty"),
        F.sum("total_amount").alias("sum_amount"),
        F.sum(cents("unit_price")).alias("sum_price_cents"),
        F.count("unit_price").alias("n_price"),
        F.sum(F.col("quantity_sold") * F.col("unit_price")).alias("sum_qty_price"),
    )


# ---------------------------------------------------------------------------
# REP-1 inventory value by category
# ---------------------------------------------------------------------------
def inventory_value(inv: DataFrame) -> DataFrame:
    q = F.col("quantity_in_stock")
    return (
        inv.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.sum(q).cast("bigint").alias("total_units"),
            _sum_money(q * F.col("cost_price")).alias("total_cost_value"),
            _sum_money(q * F.col("selling_price")).alias("total_selling_value"),
            _sum_money(q * F.col("profit_margin")).alias("potential_profit"),
            avg_money("profit_margin").alias("avg_profit_per_item"),
        )
        .orderBy(F.desc_nulls_first("total_selling_value"), "category")
    )


# ---------------------------------------------------------------------------
# REP-2 low stock with supplier contact
# ---------------------------------------------------------------------------
def low_stock_report(inv: DataFrame, sup: DataFrame) -> DataFrame:
    low = inv.where(F.col("quantity_in_stock") <= F.col("min_stock_level"))
    s = sup.select("supplier_id", "supplier_name", F.col("phone").alias("supplier_phone"))
    shortage = F.col("min_stock_level") - F.col("quantity_in_stock")
    return (
        low.join(s, "supplier_id", "left")
        .select(
            "item_code",
            "item_name",
            "category",
            "quantity_in_stock",
            "min_stock_level",
            shortage.alias("shortage"),
            "supplier_name",
            "supplier_phone",
            "cost_price",
            (shortage * F.col("cost_price")).cast("decimal(18,2)").alias("restock_cost_estimate"),
        )
        .orderBy(F.desc("shortage"), "item_code")
    )


# ---------------------------------------------------------------------------
# REP-3/4/5 sales summary by day / week / month
# ---------------------------------------------------------------------------
def _period(grain: str) -> tuple[list[Column], str]:
    d = F.col("sale_date")
    if grain == "day":
        return [d.alias("sale_date")], "sale_date"
    if grain == "week":  # Monday start, as date_trunc('week')
        return [F.date_trunc("week", d).cast("date").alias("week_start")], "week_start"
    if grain == "month":
        return [
            F.date_trunc("month", d).cast("date").alias("month_start"),
            F.date_format(d, "yyyy-MM").alias("month_label"),
        ], "month_start"
    raise ValueError(f"unknown grain {grain!r}")


def sales_summary(sales: DataFrame, grain: str = "day") -> DataFrame:
    keys, order_col = _period(grain)
    return (
        sales.groupBy(*keys)
        .agg(
            F.count_distinct("transaction_id").alias("total_transactions"),
            F.sum("quantity_sold").cast("bigint").alias("total_items_sold"),
            _sum_money(F.col("total_amount")).alias("total_revenue"),
            avg_money("total_amount").alias("avg_transaction_value"),
            F.count_distinct("item_id").alias("unique_items_sold"),
        )
        .orderBy(F.desc(order_col))
    )


# ---------------------------------------------------------------------------
# REP-6 best sellers
# ---------------------------------------------------------------------------
def best_sellers(inv: DataFrame, sales: DataFrame) -> DataFrame:
    r = item_sales_rollup(sales)
    i = inv.select("item_id", "item_code", "item_name", "category", "cost_price", "quantity_in_stock")
    j = i.join(r, "item_id", "inner")
    profit = F.col("sum_qty_price") - F.col("cost_price") * F.col("sum_qty")
    return j.select(
        "item_code",
        "item_name",
        "category",
        F.col("n_txn").alias("times_sold"),
        F.col("sum_qty").cast("bigint").alias("total_quantity_sold"),
        F.col("sum_amount").cast(SUM_T).alias("total_revenue"),
        avg_money_from(F.col("sum_price_cents"), F.col("n_price")).alias("avg_selling_price"),
        "cost_price",
        profit.cast(SUM_T).alias("total_profit"),
        F.col("quantity_in_stock").alias("current_stock"),
    ).orderBy(F.desc_nulls_first("total_revenue"), "item_code")


# ---------------------------------------------------------------------------
# REP-7 slow movers
# ---------------------------------------------------------------------------
def slow_movers(
    inv: DataFrame,
    sales: DataFrame,
    as_of: dt.date,
    max_sold: int = 5,
    stale_days: int = 30,
) -> DataFrame:
    r = item_sales_rollup(sales).select("item_id", "sum_qty", "n_txn")
    i = inv.select(
        "item_id", "item_code", "item_name", "category", "quantity_in_stock", "date_added", "cost_price"
    )
    days = F.datediff(F.lit(as_of), F.col("date_added"))
    total_sold = F.coalesce(F.col("sum_qty"), F.lit(0)).cast("bigint")
    times_sold = F.coalesce(F.col("n_txn"), F.lit(0)).cast("bigint")
    out = i.join(r, "item_id", "left").select(
        "item_code",
        "item_name",
        "category",
        "quantity_in_stock",
        "date_added",
        days.alias("days_in_inventory"),
        total_sold.alias("total_sold"),
        times_sold.alias("times_sold"),
        (F.col("quantity_in_stock") * F.col("cost_price")).cast("decimal(18,2)").alias("tied_up_capital"),
        F.when(days > 0, ratio_2dp(total_sold, days))
        .otherwise(F.lit(0).cast(AVG_T))
        .alias("avg_daily_sales"),
    )
    keep = (F.col("total_sold") < max_sold) | (
        (F.col("days_in_inventory") > stale_days) & (F.col("times_sold") == 0)
    )
    return out.where(keep).orderBy(F.desc_nulls_first("tied_up_capital"), "item_code")


# ---------------------------------------------------------------------------
# REP-8 category performance
# ---------------------------------------------------------------------------
def category_performance(inv: DataFrame, sales: DataFrame, fan_out: bool = True) -> DataFrame:
    """With ``fan_out`` the stock columns are multiplied by the item's number
    of sales rows, as the reference view's LEFT JOIN does."""
    r = item_sales_rollup(sales)
    i = inv.select("item_id", "category", "quantity_in_stock", "cost_price")
    j = i.join(r, "item_id", "left")
    mult = F.greatest(F.coalesce(F.col("n_rows"), F.lit(0)), F.lit(1)) if fan_out else F.lit(1)
    item_profit = F.col("sum_qty_price") - F.col("cost_price") * F.col("sum_qty")
    return (
        j.groupBy("category")
        .agg(
            F.count_distinct("item_id").alias("total_items"),
            F.coalesce(F.sum("n_txn"), F.lit(0)).cast("bigint").alias("total_transactions"),
            F.sum("sum_qty").cast("bigint").alias("total_units_sold"),
            F.sum("sum_amount").cast(SUM_T).alias("total_revenue"),
            F.sum(item_profit).cast(SUM_T).alias("total_profit"),
            avg_money_from(F.sum("sum_price_cents"), F.sum("n_price")).alias("avg_selling_price"),
            F.sum(F.col("quantity_in_stock") * mult).cast("bigint").alias("current_stock_units"),
            F.sum(F.col("quantity_in_stock") * F.col("cost_price") * mult).cast(SUM_T).alias("current_stock_value"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), "category")
    )


# ---------------------------------------------------------------------------
# REP-9 payment method summary
# ---------------------------------------------------------------------------
def payment_summary(sales: DataFrame) -> DataFrame:
    g = sales.groupBy("payment_method").agg(
        F.count("transaction_id").alias("transaction_count"),
        F.sum("quantity_sold").cast("bigint").alias("total_items"),
        F.sum("total_amount").alias("_rev"),
        F.sum(cents("total_amount")).alias("_rev_cents"),
        avg_money("total_amount").alias("avg_transaction_value"),
    )
    # Window over the already-aggregated rows (one per payment method).
    grand = F.sum("_rev_cents").over(Window.partitionBy())
    return g.select(
        "payment_method",
        "transaction_count",
        "total_items",
        F.col("_rev").cast(SUM_T).alias("total_revenue"),
        "avg_transaction_value",
        share_pct(F.col("_rev_cents"), grand).alias("revenue_percentage"),
    ).orderBy(F.desc_nulls_first("total_revenue"), "payment_method")


# ---------------------------------------------------------------------------
# REP-10 supplier performance
# ---------------------------------------------------------------------------
def supplier_performance(sup: DataFrame, inv: DataFrame, ords: DataFrame, fan_out: bool = True) -> DataFrame:
    """Per supplier with n item rows and m order rows the reference view joins
    max(n,1)*max(m,1) rows. Order figures are scaled by max(n,1) and stock
    figures by max(m,1) (``fan_out=True``), computed from two rollups."""
    items = inv.where(F.col("supplier_id").isNotNull()).groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("n_items_rows"),
        F.count_distinct("item_id").alias("items_supplied"),
        F.sum("quantity_in_stock").alias("stock"),
        F.sum(F.col("quantity_in_stock") * F.col("cost_price")).alias("stock_value"),
    )
    st = F.col("status")
    orders = ords.where(F.col("supplier_id").isNotNull()).groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("n_order_rows"),
        F.count("order_id").alias("n_orders"),
        F.sum(F.when(st == "Received", 1).otherwise(0)).alias("completed"),
        F.sum(F.when(st == "Pending", 1).otherwise(0)).alias("pending"),
        F.sum(F.when(st == "Cancelled", 1).otherwise(0)).alias("cancelled"),
        F.sum(F.when(st == "Received", F.col("total_cost")).otherwise(F.lit(0))).alias("spent"),
    )
    s = sup.select("supplier_id", "supplier_code", "supplier_name", "contact_person", "phone")
    j = s.join(items, "supplier_id", "left").join(orders, "supplier_id", "left")
    if fan_out:
        n_mult = F.greatest(F.coalesce(F.col("n_items_rows"), F.lit(0)), F.lit(1))
        m_mult = F.greatest(F.coalesce(F.col("n_order_rows"), F.lit(0)), F.lit(1))
    else:
        n_mult = m_mult = F.lit(1)

    def z(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    return j.select(
        "supplier_code",
        "supplier_name",
        "contact_person",
        "phone",
        z("items_supplied").cast("bigint").alias("items_supplied"),
        (z("n_orders") * n_mult).cast("bigint").alias("total_orders"),
        (z("completed") * n_mult).cast("bigint").alias("completed_orders"),
        (z("pending") * n_mult).cast("bigint").alias("pending_orders"),
        (z("cancelled") * n_mult).cast("bigint").alias("cancelled_orders"),
        (F.coalesce(F.col("spent"), F.lit(0).cast("decimal(38,2)")) * n_mult).cast(SUM_T).alias("total_spent"),
        (F.col("stock") * m_mult).cast("bigint").alias("current_stock_from_supplier"),
        (F.col("stock_value") * m_mult).cast(SUM_T).alias("current_inventory_value"),
    ).orderBy(F.desc_nulls_last("total_spent"), "supplier_code")


# ---------------------------------------------------------------------------
# REP-11 user activity
# ---------------------------------------------------------------------------
def user_activity(usr: DataFrame, sales: DataFrame) -> DataFrame:
    """Two-stage rollup: (user, day) first, so `days_active` is a plain count
    in the second stage and no distinct-aggregate expansion is needed."""
    per_day = sales.where(F.col("sold_by").isNotNull()).groupBy("sold_by", "sale_date").agg(
        F.count("transaction_id").alias("n_txn"),
        F.sum("quantity_sold").alias("qty"),
        F.sum("total_amount").alias("amount"),
        F.sum(cents("total_amount")).alias("amount_cents"),
        F.count("total_amount").alias("n_amount"),
    )
    per_user = per_day.groupBy(F.col("sold_by").alias("user_id")).agg(
        F.sum("n_txn").alias("n_txn"),
        F.sum("qty").alias("qty"),
        F.sum("amount").alias("amount"),
        F.sum("amount_cents").alias("amount_cents"),
        F.sum("n_amount").alias("n_amount"),
        F.count("sale_date").alias("days_active"),
        F.max("sale_date").alias("last_sale_date"),
    )
    u = usr.where(F.col("role").isin("Staff", "Admin")).select("user_id", "user_code", "username", "role")
    return (
        u.join(per_user, "user_id", "left")
        .select(
            "user_code",
            "username",
            "role",
            F.coalesce(F.col("n_txn"), F.lit(0)).cast("bigint").alias("total_sales"),
            F.col("qty").cast("bigint").alias("total_items_sold"),
            F.col("amount").cast(SUM_T).alias("total_revenue_generated"),
            avg_money_from(F.col("amount_cents"), F.col("n_amount")).alias("avg_transaction_value"),
            F.coalesce(F.col("days_active"), F.lit(0)).cast("bigint").alias("days_active"),
            "last_sale_date",
        )
        .orderBy(F.desc_nulls_last("total_revenue_generated"), "user_code")
    )


# ---------------------------------------------------------------------------
# REP-12 restock status
# ---------------------------------------------------------------------------
def delivery_status(status: Column, expected: Column, as_of: dt.date) -> Column:
    today = F.lit(as_of)
    pending = status == "Pending"
    return (
        F.when(pending & (expected < today), "OVERDUE")
        .when(pending & (expected == today), "DUE TODAY")
        .when(pending, "ON TIME")
        .otherwise(status)
    )


def restock_status(ords: DataFrame, sup: DataFrame, inv: DataFrame, as_of: dt.date) -> DataFrame:
    s = sup.select("supplier_id", "supplier_name")
    i = inv.select("item_id", "item_code", "item_name")
    return (
        ords.join(s, "supplier_id", "inner")
        .join(i, "item_id", "inner")
        .select(
            "order_code",
            "date_ordered",
            "expected_delivery",
            "status",
            "supplier_name",
            "item_code",
            "item_name",
            "quantity_ordered",
            "cost_per_unit",
            "total_cost",
            delivery_status(F.col("status"), F.col("expected_delivery"), as_of).alias("delivery_status"),
            F.datediff(F.lit(as_of), F.col("date_ordered")).alias("days_since_ordered"),
        )
        .orderBy(F.desc("date_ordered"), "order_code")
    )


# ---------------------------------------------------------------------------
# AGG-1..3 table functions
# ---------------------------------------------------------------------------
def low_stock_items(inv: DataFrame) -> DataFrame:
    shortage = F.col("min_stock_level") - F.col("quantity_in_stock")
    return (
        inv.where(F.col("quantity_in_stock") <= F.col("min_stock_level"))
        .select("item_code", "item_name", "category", "quantity_in_stock", "min_stock_level", shortage.alias("shortage"))
        .orderBy(F.desc("shortage"), "item_code")
    )


def inventory_totals(inv: DataFrame) -> DataFrame:
    """One row; all NULL on empty input (global aggregate)."""
    q = F.col("quantity_in_stock")
    return inv.agg(
        _sum_money(q * F.col("cost_price")).alias("total_cost_value"),
        _sum_money(q * F.col("selling_price")).alias("total_selling_value"),
        _sum_money(q * F.col("profit_margin")).alias("potential_profit"),
    )


def sales_range_summary(sales: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Inclusive date range; the filter reaches the scan (and prunes
    partitions when sales are partitioned by date). Average unrounded in the
    reference (NUMERIC); here exact to 6 decimals, half away from zero."""
    s = sales.where(F.col("sale_date").between(F.lit(start), F.lit(end)))
    avg_micro = round_ratio(F.sum(cents("total_amount")) * 10000, F.count("total_amount"))
    return s.agg(
        F.count_distinct("transaction_id").alias("total_transactions"),
        F.sum("quantity_sold").cast("bigint").alias("total_items_sold"),
        _sum_money(F.col("total_amount")).alias("total_revenue"),
        (avg_micro.cast("decimal(38,0)") / F.lit(1000000)).cast("decimal(18,6)").alias("avg_transaction_value"),
    )
