"""Adapter: the driver's TPC-H-style tables seen as the retail model.

Each function reads the Parquet tables it needs and returns a lazy typed
DataFrame of the retail model (``suppliers``, ``inventory``, ``sales_log``,
``restock_orders``, ``users``, ``activity_log``). Only the columns used
downstream are read (Catalyst prunes the rest), and the derivations are
plain column expressions, so everything stays in whole-stage codegen.

The same rules, written as SQL, are the oracle's CTEs
(`shelfspark.plans.oracle.ADAPTER_SQL`); keep the two in step.

On a cluster, run `shelfspark.sources.io.materialize_model` once and let
the reports read the written tables (sales partitioned by month of
sale_date, read back with `io.read_table`), instead of re-deriving sales
from lineitem x orders for every report.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.money import cents_to_money

# The fixed reporting date: the day after the last order date in the data.
AS_OF = dt.date(2001, 8, 2)

MODEL_TABLES = ["suppliers", "inventory", "users", "sales_log", "restock_orders", "activity_log"]


# Items nobody bought and suppliers nobody ordered from: the driver's tables
# have none, so some are derived from theirs under ids beyond all keys.
EXTRA_ID = 10**12


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a file stream, schema taken from the files. A table
    stored as a folder is watched itself (each new file is part of a later
    micro-batch); a single file is picked by name from its folder. A missing
    table raises when the schema is read."""
    schema = _read(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory()
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path) if folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _count_of(spark: SparkSession, sf_dir: str, name: str) -> Column:
    # Scalar subquery: planned as a separate tiny aggregate, not a join.
    return _read(spark, sf_dir, name).select(F.count(F.lit(1))).scalar()


def selling_price_expr(retail: Column) -> Column:
    # Through integer cents so that both engines round the double the same way.
    return cents_to_money(F.round(retail * 100).cast("long"), "decimal(10,2)")


def cost_price_expr(selling: Column) -> Column:
    return F.round(selling * F.lit(Decimal("0.6")), 2).cast("decimal(10,2)")


def category_expr(p_type: Column) -> Column:
    return (
        F.when(p_type.startswith("ECONOMY"), "Bags")
        .when(p_type.startswith("LARGE"), "Shoes")
        .when(p_type.startswith("MEDIUM"), "Wallets")
        .when(p_type.startswith("PROMO"), "Belts")
        .when(p_type.startswith("SMALL"), "Accessories")
        .otherwise("Other")
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    dormant = s.where(F.col("s_suppkey") % 9 == 0).withColumns(
        {"s_suppkey": F.col("s_suppkey") + EXTRA_ID, "s_name": F.concat(F.lit("Dormant "), F.col("s_name"))})
    s = s.unionByName(dormant)
    k = F.col("s_suppkey")
    return s.select(
        k.alias("supplier_id"),
        F.format_string("SUP%03d", k + 1).alias("supplier_code"),
        F.col("s_name").alias("supplier_name"),
        F.when(k % 4 != 0, F.concat(F.lit("Contact "), k.cast("string"))).alias("contact_person"),
        F.format_string("+%02d-%07d", F.col("s_nationkey"), k).alias("phone"),
        F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("payment_terms"),
        F.lit(None).cast("string").alias("notes"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    unsold = p.where(F.col("p_partkey") % 13 == 0).withColumns(
        {"p_partkey": F.col("p_partkey") + EXTRA_ID, "p_name": F.concat(F.lit("Unsold "), F.col("p_name"))})
    p = p.unionByName(unsold)
    k = F.col("p_partkey")
    n_sup = _count_of(spark, sf_dir, "supplier")
    selling = selling_price_expr(F.col("p_retailprice"))
    date_added = F.date_add(F.lit(dt.date(1995, 1, 1)), (k % 2000).cast("int"))
    return (
        p.select(
            k.alias("item_id"),
            F.format_string("ITM%03d", k + 1).alias("item_code"),
            category_expr(F.col("p_type")).alias("category"),
            F.col("p_name").alias("item_name"),
            F.concat_ws(" ", F.col("p_brand"), F.lower(F.col("p_type")), F.col("p_name")).alias("description"),
            F.format_string("SKU-%06d", k).alias("sku"),
            ((k * 37) % 61).cast("int").alias("quantity_in_stock"),
            (F.col("p_size") % 11 + 5).cast("int").alias("min_stock_level"),
            selling.alias("selling_price"),
            F.when(k % 10 != 0, (k * 7) % n_sup).alias("supplier_id"),
            date_added.alias("date_added"),
            F.date_add(date_added, (k % 97).cast("int")).alias("last_restocked"),
        )
        .withColumn("cost_price", cost_price_expr(F.col("selling_price")))
        .withColumn("profit_margin", (F.col("selling_price") - F.col("cost_price")).cast("decimal(10,2)"))
        .select(
            "item_id", "item_code", "category", "item_name", "description", "sku",
            "quantity_in_stock", "min_stock_level", "cost_price", "selling_price",
            "profit_margin", "supplier_id", "date_added", "last_restocked",
        )
    )


def sales_log(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One sale per line item. ``lineitem`` may be a streaming frame (then
    this is a stream-static join with orders)."""
    return sale_columns(sale_lines(spark, sf_dir, lineitem))


def sale_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Line items with their order, in the tables' own narrow columns: further joins go here, before the texts are made."""
    li = lineitem if lineitem is not None else _read(spark, sf_dir, "lineitem")
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner")


def sale_columns(lines: DataFrame, *others: str) -> DataFrame:
    """The sales of `sale_lines`, with ``others`` of their columns."""
    pk = F.col("l_partkey")
    qty = F.col("l_quantity").cast("int")
    unit_cents = F.floor(F.round(F.col("l_extendedprice") * 100) / F.col("l_quantity"))
    unit_price = cents_to_money(unit_cents, "decimal(10,2)")
    ok = F.col("l_orderkey")
    ln = F.col("l_linenumber")
    prio = F.col("o_orderpriority")
    return lines.select(
        ok.alias("transaction_id"),
        F.format_string("TXN%08d-%02d", ok, ln).alias("transaction_code"),
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.format_string("%02d:%02d:%02d", ok % 12 + 8, (ok * 7 + ln) % 60, (ln * 13) % 60).alias("sale_time"),
        pk.alias("item_id"),
        qty.alias("quantity_sold"),
        unit_price.alias("unit_price"),
        (qty * unit_price).cast("decimal(12,2)").alias("total_amount"),
        F.when(prio.startswith("1"), "Cash")
        .when(prio.startswith("2"), "Card")
        .when(prio.startswith("3"), "Bank Transfer")
        .otherwise("Other")
        .alias("payment_method"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("sold_by"),
        F.lit(None).cast("string").alias("notes"),
        ln.alias("line_no"),
        *others,
    )


def restock_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One restock order per line item."""
    return order_columns(order_lines(spark, sf_dir))


def order_lines(spark: SparkSession, sf_dir: str, suppliers: DataFrame | None = None) -> DataFrame:
    """Line items with their order and part, in the tables' own narrow columns, and with what ``suppliers`` (s_key and
    other columns) say of their supplier, if given."""
    li = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    if suppliers is not None:
        j = j.join(suppliers, F.col("l_suppkey") == F.col("s_key"), "left")
    return j.join(part, F.col("l_partkey") == F.col("p_partkey"))


def order_columns(lines: DataFrame, *others: str) -> DataFrame:
    """The restock orders of `order_lines`, with ``others`` of their columns."""
    qty = F.col("l_quantity").cast("int")
    cost = cost_price_expr(selling_price_expr(F.col("p_retailprice")))
    ordered = F.col("o_orderdate").cast("date")
    status = (
        F.when(F.col("l_returnflag") == "R", "Cancelled")
        .when(F.col("l_linestatus") == "O", "Pending")
        .otherwise("Received")
    )
    expected = F.date_add(ordered, qty)
    return lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("order_id"),
        F.format_string("PO%08d-%02d", F.col("l_orderkey"), F.col("l_linenumber")).alias("order_code"),
        ordered.alias("date_ordered"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_partkey").alias("item_id"),
        qty.alias("quantity_ordered"),
        cost.alias("cost_per_unit"),
        (qty * cost).cast("decimal(12,2)").alias("total_cost"),
        expected.alias("expected_delivery"),
        status.alias("status"),
        F.when(status == "Received", expected).alias("date_received"),
        F.lit(None).cast("string").alias("notes"),
        *others,
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("user_id"),
        F.format_string("USR%03d", k + 1).alias("user_code"),
        F.col("c_name").alias("username"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.lit("pending_migration").alias("password_hash"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Admin").otherwise("Staff").alias("role"),
        F.when(k % 20 == 0, "Suspended").when(k % 33 == 0, "Locked").otherwise("Active").alias("account_status"),
        F.when(k % 50 != 0, k - k % 50).alias("created_by"),
        F.lit(None).cast("timestamp_ntz").alias("last_login"),
        F.lit(0).alias("failed_login_attempts"),
        F.lit(None).cast("string").alias("notes"),
    )


# event_type -> audit action, fixed mapping of the adapter.
EVENT_ACTIONS = {
    "signup": "LOGIN",
    "error": "LOGIN_FAILED",
    "purchase": "RECORD_SALE",
    "click": "RESTOCK",
    "view": "VIEW_REPORT",
}


def activity_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Audit rows. Sales and restocks carry their quantity and item code only
    in the details text, as the web paths of the reference write them.
    ``events`` may be a streaming frame."""
    e = events if events is not None else _read(spark, sf_dir, "events")
    n_items = _count_of(spark, sf_dir, "part")
    et = F.col("event_type")
    action = F.lit("OTHER")
    for src, dst in reversed(list(EVENT_ACTIONS.items())):
        action = F.when(et == src, dst).otherwise(action)
    k = F.get_json_object(F.col("props"), "$.k").cast("long")
    qty = k % 10 + 1
    code = F.format_string("ITM%03d", (F.col("event_id") * 7) % n_items + 1)
    details = (
        F.when(et == "purchase", F.format_string("Sold %d of %s", qty, code))
        .when(et == "click", F.format_string("Restocked %d units of %s", qty, code))
        .when(et == "signup", F.lit("User logged in"))
        .when(et == "error", F.lit("Invalid username or password"))
        .otherwise(F.lit("Viewed report"))
    )
    return e.select(
        F.col("event_id").alias("log_id"),
        F.col("user_id"),
        action.alias("action"),
        details.alias("details"),
        F.lit(None).cast("string").alias("ip_address"),
        F.lit(None).cast("string").alias("user_agent"),
        F.col("ts").alias("created_at"),
    )


def login_attempts(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Login attempts (signup = success, error = failure) with the username
    typed, as the lockout rule keys on it. ``events`` may be streaming."""
    e = (events if events is not None else _read(spark, sf_dir, "events")).where(F.col("event_type").isin("signup", "error"))
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return e.join(c, e.user_id == c.c_custkey, "inner").select(
        F.col("event_id").alias("attempt_id"),
        F.col("ts"),
        F.col("user_id"),
        F.col("c_name").alias("username"),
        (F.col("event_type") == "signup").alias("success"),
    )


def load_model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "suppliers": suppliers(spark, sf_dir),
        "inventory": inventory(spark, sf_dir),
        "users": users(spark, sf_dir),
        "sales_log": sales_log(spark, sf_dir),
        "restock_orders": restock_orders(spark, sf_dir),
        "activity_log": activity_log(spark, sf_dir),
    }
