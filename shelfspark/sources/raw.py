"""Raw legacy frames (every field text) derived from the adapted tables.

The reference ingests header CSV snapshots of worksheets whose cells are
typed by hand. These functions render the typed model back into that text
layout, with deterministic dirt (currency marks, mixed date layouts, blank
cells, '5.0' quantities, missing codes), so the ingest, cleaning and raw
report operators run over data that grows with the driver tables. The SQL
twin is `shelfspark.plans.oracle.RAW_SQL`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources import adapter as A


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _date_text(d: Column, k: Column) -> Column:
    return (
        F.when(d.isNull(), F.lit(""))
        .when(k % 3 == 0, F.date_format(d, "M/d/yyyy"))
        .when(k % 3 == 1, F.date_format(d, "d-MMM-yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )


def raw_suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = A.suppliers(spark, d)
    return s.select(
        F.col("supplier_code").alias("Supplier_ID"),
        F.col("supplier_name").alias("Supplier_Name"),
        _s(F.col("contact_person")).alias("Contact_Person"),
        _s(F.col("phone")).alias("Phone"),
        _s(F.col("email")).alias("Email"),
        _s(F.col("address")).alias("Address"),
        _s(F.col("payment_terms")).alias("Payment_Terms"),
        _s(F.col("notes")).alias("Notes"),
    )


def raw_inventory(spark: SparkSession, d: str) -> DataFrame:
    inv = A.inventory(spark, d)
    sup = A.suppliers(spark, d).select("supplier_id", "supplier_name")
    k = F.col("item_id")
    q = F.col("quantity_in_stock")
    return inv.join(sup, "supplier_id", "left").select(
        F.col("item_code").alias("Item_ID"),
        F.col("category").alias("Category"),
        F.col("item_name").alias("Item_Name"),
        F.col("description").alias("Description"),
        F.when(k % 29 == 0, F.lit("N/A"))
        .when(k % 23 == 0, F.concat(q.cast("string"), F.lit(".0")))
        .otherwise(q.cast("string"))
        .alias("Quantity_In_Stock"),
        F.when(k % 19 == 0, F.lit(""))
        .when(k % 7 == 0, F.concat(F.lit("$"), F.col("cost_price").cast("string")))
        .otherwise(F.col("cost_price").cast("string"))
        .alias("Cost_Price"),
        F.when(k % 11 == 0, F.concat(F.lit("฿"), F.col("selling_price").cast("string")))
        .otherwise(F.col("selling_price").cast("string"))
        .alias("Selling_Price"),
        F.when(F.col("supplier_name").isNotNull(), F.col("supplier_name"))
        .when(k % 20 == 0, F.concat(F.lit("Walk-in Vendor "), (k % 7).cast("string")))
        .otherwise(F.lit(""))
        .alias("Supplier_Name"),
        _date_text(F.col("date_added"), k).alias("Date_Added"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.date_format("last_restocked", "yyyy-MM-dd")).alias("Last_Restocked"),
        F.col("min_stock_level").cast("string").alias("Min_Stock_Level"),
        F.col("sku").alias("SKU"),
    )


def raw_users(spark: SparkSession, d: str) -> DataFrame:
    u = A.users(spark, d)
    k = F.col("user_id")
    return u.select(
        F.col("user_code").alias("User_ID"),
        F.col("username").alias("Username"),
        F.col("email").alias("Email"),
        F.col("password_hash").alias("Password_Hash"),
        F.col("role").alias("Role"),
        F.lit("").alias("Created_Date"),
        F.lit("").alias("Last_Login"),
        F.col("account_status").alias("Account_Status"),
        F.when(F.col("created_by").isNull(), F.lit(""))
        .otherwise(F.format_string("USR%03d", F.col("created_by") + 1))
        .alias("Created_By"),
        F.when(k % 7 == 0, F.lit("night shift")).otherwise(F.lit("")).alias("Notes"),
    )


def _names(spark: SparkSession, d: str) -> DataFrame:
    return A.inventory(spark, d).select(F.col("item_id").alias("_item"), "item_code", "item_name")


def raw_sales(spark: SparkSession, d: str) -> DataFrame:
    # The names join the lines before the sales' texts are made, so that the shuffle by item moves narrow rows.
    lines = A.sale_lines(spark, d).join(_names(spark, d), F.col("l_partkey") == F.col("_item"), "left")
    s = A.sale_columns(lines, "item_code", "item_name")
    t = F.col("transaction_id") + F.col("line_no")
    q = F.col("quantity_sold")
    return s.select(
        F.when(t % 5 == 0, F.date_format("sale_date", "M/d/yyyy"))
        .otherwise(F.date_format("sale_date", "yyyy-MM-dd"))
        .alias("Date"),
        F.col("sale_time").alias("Time"),
        F.when(t % 31 == 0, F.lit("")).otherwise(_s(F.col("item_code"))).alias("Item_ID"),
        _s(F.col("item_name")).alias("Item_Name"),
        F.when(t % 13 == 0, F.concat(q.cast("string"), F.lit(".0"))).otherwise(q.cast("string")).alias("Quantity_Sold"),
        F.when(t % 7 == 0, F.concat(F.lit("$"), F.col("unit_price").cast("string")))
        .otherwise(F.col("unit_price").cast("string"))
        .alias("Unit_Price"),
        F.when(t % 17 == 0, F.lit("")).otherwise(F.col("total_amount").cast("string")).alias("Total_Amount"),
        F.when(t % 19 == 0, F.lit("")).otherwise(F.col("payment_method")).alias("Payment_Method"),
        F.when(F.col("sold_by").isNull(), F.lit(""))
        .otherwise(F.format_string("USR%03d", F.col("sold_by") + 1))
        .alias("Sold_By"),
        F.col("transaction_code").alias("Transaction_ID"),
    )


def raw_orders(spark: SparkSession, d: str) -> DataFrame:
    sup = A.suppliers(spark, d).select(F.col("supplier_id").alias("s_key"), "supplier_name")
    lines = A.order_lines(spark, d, sup).join(_names(spark, d), F.col("l_partkey") == F.col("_item"), "left")
    o = A.order_columns(lines, "supplier_name", "item_code", "item_name")
    k = F.col("order_id")
    return o.select(
        F.col("order_code").alias("Order_ID"),
        _date_text(F.col("date_ordered"), k).alias("Date_Ordered"),
        _s(F.col("supplier_name")).alias("Supplier_Name"),
        _s(F.col("item_code")).alias("Item_ID"),
        _s(F.col("item_name")).alias("Item_Name"),
        F.col("quantity_ordered").cast("string").alias("Quantity_Ordered"),
        F.col("cost_per_unit").cast("string").alias("Cost_Per_Unit"),
        F.date_format("expected_delivery", "yyyy-MM-dd").alias("Expected_Delivery"),
        F.col("status").alias("Status"),
        F.when(F.col("date_received").isNull(), F.lit("")).otherwise(F.date_format("date_received", "yyyy-MM-dd")).alias("Date_Received"),
    )
