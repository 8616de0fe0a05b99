"""Reports over raw legacy text frames (AGG-4..7, FLT-3 raw, FLT-5, AGG-9).

The reference computes these in Python loops over CSV rows; here they are
parse-then-aggregate plans. Parsing is `try_cast` (exact decimals for money,
so totals do not depend on summation order); a cell that does not parse is
skipped where the reference skips it. Where the reference would crash on a
bad cell (e.g. int('2.0') in the daily report) the cell is skipped instead.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.schemas import DEFAULT_MIN_STOCK, LOW_STOCK_CRITICAL

SUM_T = "decimal(38,2)"


def _int_cell(c: str) -> Column:
    """Python int(text): optional sign and blanks around digits; '2.0' fails."""
    return F.trim(F.col(c)).try_cast("bigint")


def _money_cell(c: str) -> Column:
    """Python float(text) on a money cell, as an exact decimal."""
    return F.trim(F.col(c)).try_cast("decimal(20,4)")


def _day_filter(raw: DataFrame, day: dt.date | str | None) -> DataFrame:
    if day is None:
        return raw
    return raw.where(F.col("Date") == F.lit(str(day)))


# AGG-4
def daily_headline(raw_sales: DataFrame, day: dt.date | str | None = None) -> DataFrame:
    """Per Date text: revenue (blank / bad amounts skipped), transactions =
    number of rows, items sold (blank / bad quantities skipped)."""
    s = _day_filter(raw_sales, day)
    return s.groupBy("Date").agg(
        F.coalesce(F.sum(_money_cell("Total_Amount")), F.lit(0)).cast(SUM_T).alias("total_revenue"),
        F.count(F.lit(1)).alias("transactions"),
        F.coalesce(F.sum(_int_cell("Quantity_Sold")), F.lit(0)).cast("bigint").alias("items_sold"),
    )


# AGG-5
def daily_payment_mix(raw_sales: DataFrame, day: dt.date | str | None = None) -> DataFrame:
    """Per Date and non-blank payment method: number of rows and amount."""
    s = _day_filter(raw_sales, day).where(F.coalesce(F.col("Payment_Method"), F.lit("")) != "")
    return s.groupBy("Date", "Payment_Method").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.coalesce(F.sum(_money_cell("Total_Amount")), F.lit(0)).cast(SUM_T).alias("amount"),
    )


# AGG-6
def daily_best_seller(raw_sales: DataFrame, day: dt.date | str | None = None, seq: str = "Transaction_ID") -> DataFrame:
    """Per Date, the item name with the most units (not revenue), with its
    revenue. A tie goes to the item seen first (smallest ``seq``), then to
    the name. Item-level partial aggregates first; the best of a day is
    an aggregate too, so a day costs one row per task."""
    s = _day_filter(raw_sales, day)
    per_item = s.groupBy("Date", "Item_Name").agg(
        F.coalesce(F.sum(_int_cell("Quantity_Sold")), F.lit(0)).cast("bigint").alias("quantity"),
        F.coalesce(F.sum(_money_cell("Total_Amount")), F.lit(0)).cast(SUM_T).alias("revenue"),
        F.min(seq).alias("_first"),
    )
    best = F.min(F.struct((-F.col("quantity")).alias("_less"), "_first", "Item_Name", "quantity", "revenue")).alias("_best")
    return per_item.groupBy("Date").agg(best).select(
        "Date", F.col("_best.Item_Name").alias("best_seller"), "_best.quantity", "_best.revenue"
    )


# AGG-7
def raw_inventory_value(raw_inv: DataFrame) -> DataFrame:
    """Units, potential revenue, cost and profit over rows whose quantity,
    price and cost all parse; unique_items counts every row. Without a
    Cost_Price column cost is 0 for all rows. Cost and profit are NULL
    ("Data N/A") unless total cost > 0."""
    has_cost = "Cost_Price" in raw_inv.columns
    q = _int_cell("Quantity_In_Stock") if "Quantity_In_Stock" in raw_inv.columns else F.lit(0).cast("bigint")
    p = _money_cell("Selling_Price") if "Selling_Price" in raw_inv.columns else F.lit(0).cast("decimal(20,4)")
    c = _money_cell("Cost_Price") if has_cost else F.lit(0).cast("decimal(20,4)")
    ok = q.isNotNull() & p.isNotNull() & c.isNotNull()
    g = raw_inv.agg(
        F.coalesce(F.sum(F.when(ok, q)), F.lit(0)).cast("bigint").alias("total_units"),
        F.count(F.lit(1)).alias("unique_items"),
        F.coalesce(F.sum(F.when(ok, q * p)), F.lit(0)).cast(SUM_T).alias("potential_revenue"),
        F.coalesce(F.sum(F.when(ok, q * c)), F.lit(0)).cast(SUM_T).alias("_cost"),
    )
    return g.select(
        "total_units",
        "unique_items",
        "potential_revenue",
        F.when(F.col("_cost") > 0, F.col("_cost")).alias("total_cost"),
        F.when(F.col("_cost") > 0, F.col("potential_revenue") - F.col("_cost")).cast(SUM_T).alias("potential_profit"),
    )


# FLT-3 on the raw layer
def raw_low_stock(raw_inv: DataFrame, default_min: int = DEFAULT_MIN_STOCK) -> DataFrame:
    """Rows with stock <= min level. Rows whose numbers do not parse are
    skipped; the default min applies only when the column is absent."""
    q = _int_cell("Quantity_In_Stock")
    m = _int_cell("Min_Stock_Level") if "Min_Stock_Level" in raw_inv.columns else F.lit(default_min).cast("bigint")
    return (
        raw_inv.withColumn("quantity", q)
        .withColumn("min_level", m)
        .where(F.col("quantity").isNotNull() & F.col("min_level").isNotNull() & (F.col("quantity") <= F.col("min_level")))
    )


# FLT-5
def low_stock_alert(raw_inv: DataFrame, default_min: int = DEFAULT_MIN_STOCK, seq: str = "Item_ID") -> DataFrame:
    """Low stock list with severity (critical at qty <= 2, else warning),
    lowest stock first; equal stock keeps file order (``seq``)."""
    low = raw_low_stock(raw_inv, default_min)
    return low.select(
        F.col("Item_ID").alias("item_id"),
        F.col("Item_Name").alias("item_name"),
        "quantity",
        "min_level",
        F.when(F.col("quantity") <= LOW_STOCK_CRITICAL, "critical").otherwise("warning").alias("severity"),
        F.col(seq).alias("_seq"),
    ).orderBy("quantity", "_seq").drop("_seq")


# FLT-4
def stock_status(inv: DataFrame) -> DataFrame:
    return inv.withColumn(
        "stock_status",
        F.when(F.col("quantity_in_stock") <= F.col("min_stock_level"), "LOW STOCK").otherwise("OK"),
    )


# AGG-9
def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one row each (one count job per table plan, all
    unioned into a single result frame)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
