"""Raw-layer reports and ingest queries over the raw legacy frames derived
from the driver tables (`shelfspark.sources.raw`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import etl as E
from shelfspark.operators import raw_reports as RR
from shelfspark.plans.catalog import AS_OF, AS_OF_SQL, MS, M2, register
from shelfspark.plans.oracle import RAW_SQL, clean_date_sql, clean_int_sql, clean_money_sql
from shelfspark.sources import adapter as A
from shelfspark.sources import raw as W
from shelfspark.sources.io import Steps


def _int_cell(x: str) -> str:
    # Python int(text): optional sign and surrounding blanks, digits only.
    return f"(CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+') THEN TRY_CAST(trim({x}) AS BIGINT) END)"


def _money_cell(x: str) -> str:
    return f"TRY_CAST(trim({x}) AS DECIMAL(20,4))"


@register(
    "daily_headline",
    [("Date", "VARCHAR"), ("total_revenue", MS), ("transactions", "BIGINT"), ("items_sold", "BIGINT")],
    f"""
SELECT Date, COALESCE(SUM({_money_cell('Total_Amount')}), 0) AS total_revenue, COUNT(*) AS transactions,
       COALESCE(SUM({_int_cell('Quantity_Sold')}), 0) AS items_sold
FROM raw_sales GROUP BY Date""",
    extra_ctes=RAW_SQL,
    notes="AGG-4 for every date in the raw sales log",
)
def q_daily_headline(spark, d):
    return RR.daily_headline(W.raw_sales(spark, d))


@register(
    "daily_payment_mix",
    [("Date", "VARCHAR"), ("Payment_Method", "VARCHAR"), ("transactions", "BIGINT"), ("amount", MS)],
    f"""
SELECT Date, Payment_Method, COUNT(*) AS transactions, COALESCE(SUM({_money_cell('Total_Amount')}), 0) AS amount
FROM raw_sales WHERE COALESCE(Payment_Method, '') <> '' GROUP BY Date, Payment_Method""",
    extra_ctes=RAW_SQL,
)
def q_daily_payment_mix(spark, d):
    return RR.daily_payment_mix(W.raw_sales(spark, d))


@register(
    "daily_best_seller",
    [("Date", "VARCHAR"), ("best_seller", "VARCHAR"), ("quantity", "BIGINT"), ("revenue", MS)],
    f"""
SELECT Date, Item_Name AS best_seller, quantity, revenue FROM (
  SELECT Date, Item_Name, quantity, revenue,
         row_number() OVER (PARTITION BY Date ORDER BY quantity DESC, first_seen ASC, Item_Name ASC) AS rk
  FROM (SELECT Date, Item_Name, COALESCE(SUM({_int_cell('Quantity_Sold')}), 0) AS quantity,
               COALESCE(SUM({_money_cell('Total_Amount')}), 0) AS revenue, MIN(Transaction_ID) AS first_seen
        FROM raw_sales GROUP BY Date, Item_Name) t
) r WHERE rk = 1""",
    extra_ctes=RAW_SQL,
    notes="AGG-6: most units per day, ties to the first seen",
)
def q_daily_best_seller(spark, d):
    return RR.daily_best_seller(W.raw_sales(spark, d))


@register(
    "raw_inventory_value",
    [("total_units", "BIGINT"), ("unique_items", "BIGINT"), ("potential_revenue", MS), ("total_cost", MS),
     ("potential_profit", MS)],
    f"""
SELECT total_units, unique_items, potential_revenue,
       CASE WHEN cost > 0 THEN cost END AS total_cost,
       CASE WHEN cost > 0 THEN potential_revenue - cost END AS potential_profit
FROM (
  SELECT COALESCE(SUM(CASE WHEN ok THEN q END), 0) AS total_units, COUNT(*) AS unique_items,
         COALESCE(SUM(CASE WHEN ok THEN q * p END), 0) AS potential_revenue,
         COALESCE(SUM(CASE WHEN ok THEN q * c END), 0) AS cost
  FROM (SELECT {_int_cell('Quantity_In_Stock')} AS q, {_money_cell('Selling_Price')} AS p,
               {_money_cell('Cost_Price')} AS c,
               {_int_cell('Quantity_In_Stock')} IS NOT NULL AND {_money_cell('Selling_Price')} IS NOT NULL
               AND {_money_cell('Cost_Price')} IS NOT NULL AS ok
        FROM raw_inventory) x
) t""",
    extra_ctes=RAW_SQL,
    notes="AGG-7",
)
def q_raw_inventory_value(spark, d):
    return RR.raw_inventory_value(W.raw_inventory(spark, d))


@register(
    "low_stock_alert",
    [("item_id", "VARCHAR"), ("item_name", "VARCHAR"), ("quantity", "BIGINT"), ("min_level", "BIGINT"),
     ("severity", "VARCHAR")],
    f"""
SELECT Item_ID AS item_id, Item_Name AS item_name, q AS quantity, m AS min_level,
       CASE WHEN q <= 2 THEN 'critical' ELSE 'warning' END AS severity
FROM (SELECT *, {_int_cell('Quantity_In_Stock')} AS q, {_int_cell('Min_Stock_Level')} AS m FROM raw_inventory) x
WHERE q IS NOT NULL AND m IS NOT NULL AND q <= m
ORDER BY q, Item_ID""",
    extra_ctes=RAW_SQL,
    notes="FLT-3 on raw text + FLT-5 severity",
)
def q_low_stock_alert(spark, d):
    return RR.low_stock_alert(W.raw_inventory(spark, d))


@register(
    "table_counts",
    [("table_name", "VARCHAR"), ("row_count", "BIGINT")],
    """
SELECT 'suppliers' AS table_name, COUNT(*) AS row_count FROM suppliers
UNION ALL SELECT 'inventory', COUNT(*) FROM inventory
UNION ALL SELECT 'users', COUNT(*) FROM users
UNION ALL SELECT 'sales_log', COUNT(*) FROM sales_log
UNION ALL SELECT 'restock_orders', COUNT(*) FROM restock_orders
UNION ALL SELECT 'activity_log', COUNT(*) FROM activity_log""",
    notes="AGG-9",
)
def q_table_counts(spark, d):
    return RR.table_counts(A.load_model(spark, d))


# ---------------------------------------------------------------------------
# Ingest (ETL-3) chains: raw suppliers -> inventory -> users -> sales / orders
# ---------------------------------------------------------------------------
def _loaded(spark, d):
    sup, _ = E.load_suppliers(W.raw_suppliers(spark, d))
    inv, _ = E.load_inventory(W.raw_inventory(spark, d), sup, AS_OF)
    usr, _ = E.load_users(W.raw_users(spark, d))
    return sup, inv, usr


LOAD_CTES = RAW_SQL.strip() + f""",
loaded_suppliers AS (
  SELECT Supplier_ID AS supplier_id, Supplier_ID AS supplier_code, Supplier_Name AS supplier_name,
         lpad(regexp_extract(Supplier_ID, '([0-9]+)[^0-9]*$', 1), 20, '0') || Supplier_ID AS seq
  FROM raw_suppliers WHERE COALESCE(Supplier_Name, '') <> ''
),
sup_keys AS (
  SELECT k, arg_max(id, seq) AS id FROM (
    SELECT supplier_code AS k, supplier_id AS id, seq FROM loaded_suppliers
    UNION ALL SELECT supplier_name, supplier_id, seq FROM loaded_suppliers) t
  WHERE COALESCE(k, '') <> '' GROUP BY k
),
inv_typed AS (
  SELECT r.Item_ID AS item_code, r.Category AS category, r.Item_Name AS item_name,
         {clean_int_sql('r.Quantity_In_Stock')} AS quantity_in_stock,
         {clean_int_sql('r.Min_Stock_Level')} AS min_stock_level,
         {clean_money_sql('r.Cost_Price')} AS cost_price,
         {clean_money_sql('r.Selling_Price')} AS selling_price,
         sk.id AS supplier_id,
         COALESCE({clean_date_sql('r.Date_Added')}, {AS_OF_SQL}) AS date_added,
         {clean_date_sql('r.Last_Restocked')} AS last_restocked,
         lpad(regexp_extract(r.Item_ID, '([0-9]+)[^0-9]*$', 1), 20, '0') || r.Item_ID AS seq
  FROM raw_inventory r LEFT JOIN sup_keys sk ON r.Supplier_Name = sk.k
),
loaded_inventory AS (
  SELECT * FROM inv_typed
  WHERE COALESCE(item_name, '') <> '' AND category IN ('Bags', 'Shoes', 'Wallets', 'Belts', 'Accessories', 'Other')
    AND quantity_in_stock >= 0 AND cost_price >= 0 AND selling_price >= 0
),
item_keys AS (
  SELECT k, arg_max(id, seq) AS id FROM (
    SELECT item_code AS k, item_code AS id, seq FROM loaded_inventory
    UNION ALL SELECT item_name, item_code, seq FROM loaded_inventory) t
  WHERE COALESCE(k, '') <> '' GROUP BY k
),
loaded_users AS (
  SELECT User_ID AS user_code, Username AS username, lpad(regexp_extract(User_ID, '([0-9]+)[^0-9]*$', 1), 20, '0') || User_ID AS seq FROM raw_users
  WHERE COALESCE(Username, '') <> '' AND Role IN ('Admin', 'Staff')
    AND Account_Status IN ('Active', 'Suspended', 'Locked')
),
user_keys AS (
  SELECT k, arg_max(id, seq) AS id FROM (
    SELECT user_code AS k, user_code AS id, seq FROM loaded_users
    UNION ALL SELECT username, user_code, seq FROM loaded_users) t
  WHERE COALESCE(k, '') <> '' GROUP BY k
),
sales_resolved AS (
  SELECT r.*, COALESCE(k1.id, k2.id) AS res_item, u.id AS res_seller,
         {clean_int_sql('r.Quantity_Sold')} AS qty, {clean_money_sql('r.Unit_Price')} AS price
  FROM raw_sales r
  LEFT JOIN item_keys k1 ON r.Item_ID = k1.k
  LEFT JOIN item_keys k2 ON r.Item_Name = k2.k
  LEFT JOIN user_keys u ON r.Sold_By = u.k
),
sales_ruled AS (
  SELECT *, CASE WHEN res_item IS NULL THEN 'item not found'
                 WHEN qty <= 0 THEN 'invalid quantity'
                 WHEN price < 0 THEN 'negative price'
                 WHEN Payment_Method NOT IN ('Cash', 'Card', 'Bank Transfer', 'Other') THEN 'invalid payment method'
                 WHEN NOT regexp_full_match(Time, '[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?') THEN 'invalid time'
            END AS rule
  FROM sales_resolved
),
sales_checked AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN rule
                 WHEN row_number() OVER (PARTITION BY Transaction_ID, rule IS NULL ORDER BY Date, Time, Item_ID, Item_Name,
                        Quantity_Sold, Unit_Price, Total_Amount, Payment_Method, Sold_By) > 1
                 THEN 'duplicate code' END AS reject_reason
  FROM sales_ruled
)"""


@register(
    "load_inventory",
    [("item_id", "VARCHAR"), ("item_code", "VARCHAR"), ("category", "VARCHAR"), ("item_name", "VARCHAR"),
     ("quantity_in_stock", "INTEGER"), ("min_stock_level", "INTEGER"), ("cost_price", M2),
     ("selling_price", M2), ("profit_margin", M2), ("supplier_id", "VARCHAR"), ("date_added", "DATE"),
     ("last_restocked", "DATE")],
    """
SELECT item_code AS item_id, item_code, category, item_name, quantity_in_stock, min_stock_level,
       cost_price, selling_price, CAST(selling_price - cost_price AS DECIMAL(10,2)) AS profit_margin,
       supplier_id, date_added, last_restocked
FROM loaded_inventory""",
    extra_ctes=LOAD_CTES,
    notes="ETL-1/2/3 + JOI-7: raw inventory text -> typed rows, supplier by name",
)
def q_load_inventory(spark, d):
    return _loaded(spark, d)[1]


def _in_turn(steps):
    """Steps that are each made from the one before only, which goes once the next is stored."""
    before = []

    def step(df, name):
        out = steps(df, name)
        if out is not df:
            for old in before:
                steps.drop(old)
            before[:] = [name]
        return out

    return step


def _load_sales(spark, d, *stored):
    """(good, rejects): the rows are stored after each of their wide shuffles; ``stored``: the steps that the result goes through."""
    _, inv, usr = _loaded(spark, d)
    step = _in_turn(Steps(spark, "load-sales", stored or None))
    return E.load_sales(step(W.raw_sales(spark, d), "raw"), inv, usr, AS_OF, step=step)


_SALES_COLS = [("transaction_code", "VARCHAR"), ("sale_date", "DATE"), ("sale_time", "VARCHAR"),
               ("item_id", "VARCHAR"), ("quantity_sold", "INTEGER"), ("unit_price", M2),
               ("total_amount", "DECIMAL(12,2)"), ("payment_method", "VARCHAR"), ("sold_by", "VARCHAR")]


@register(
    "load_sales",
    _SALES_COLS,
    f"""
SELECT Transaction_ID AS transaction_code, COALESCE({clean_date_sql('Date')}, {AS_OF_SQL}) AS sale_date,
       Time AS sale_time, res_item AS item_id, qty AS quantity_sold, price AS unit_price,
       CAST(qty * price AS DECIMAL(12,2)) AS total_amount, Payment_Method AS payment_method, res_seller AS sold_by
FROM sales_checked WHERE reject_reason IS NULL""",
    extra_ctes=LOAD_CTES,
    notes="ETL-3 sales: item by old code else name, seller by code or name",
)
def q_load_sales(spark, d):
    return _load_sales(spark, d)[0]


@register(
    "load_sales_rejects",
    [("Transaction_ID", "VARCHAR"), ("Item_ID", "VARCHAR"), ("reject_reason", "VARCHAR")],
    """
SELECT Transaction_ID, Item_ID, reject_reason FROM sales_checked WHERE reject_reason IS NOT NULL""",
    extra_ctes=LOAD_CTES,
    notes="ETL-3 quarantine: rows the typed sales table would refuse",
)
def q_load_sales_rejects(spark, d):
    bad = _load_sales(spark, d, "raw", "items")[1]
    return bad.select("Transaction_ID", "Item_ID", "reject_reason")


@register(
    "load_orders",
    [("order_code", "VARCHAR"), ("date_ordered", "DATE"), ("supplier_id", "VARCHAR"), ("item_id", "VARCHAR"),
     ("quantity_ordered", "INTEGER"), ("cost_per_unit", M2), ("total_cost", "DECIMAL(12,2)"),
     ("expected_delivery", "DATE"), ("status", "VARCHAR"), ("date_received", "DATE")],
    f"""
SELECT Order_ID AS order_code, COALESCE({clean_date_sql('Date_Ordered')}, {AS_OF_SQL}) AS date_ordered,
       res_supplier AS supplier_id, res_item AS item_id, qty AS quantity_ordered, cost AS cost_per_unit,
       CAST(qty * cost AS DECIMAL(12,2)) AS total_cost, {clean_date_sql('Expected_Delivery')} AS expected_delivery,
       Status AS status, rec AS date_received
FROM (SELECT *, row_number() OVER (PARTITION BY Order_ID ORDER BY Date_Ordered, Item_ID, Quantity_Ordered,
        Supplier_Name, Item_Name, Cost_Per_Unit, Expected_Delivery, Status, Date_Received) AS nth FROM (
  SELECT r.*, s.id AS res_supplier, COALESCE(k1.id, k2.id) AS res_item,
         {clean_int_sql('r.Quantity_Ordered')} AS qty, {clean_money_sql('r.Cost_Per_Unit')} AS cost,
         {clean_date_sql('r.Date_Received')} AS rec
  FROM raw_orders r
  LEFT JOIN sup_keys s ON r.Supplier_Name = s.k
  LEFT JOIN item_keys k1 ON r.Item_ID = k1.k
  LEFT JOIN item_keys k2 ON r.Item_Name = k2.k
) x
WHERE res_supplier IS NOT NULL AND res_item IS NOT NULL AND qty > 0 AND cost >= 0
  AND Status IN ('Pending', 'Received', 'Cancelled') AND ((Status = 'Received') = (rec IS NOT NULL))) y
WHERE nth = 1""",
    extra_ctes=LOAD_CTES,
    notes="ETL-3 restock orders: supplier by name, item by code else name",
)
def q_load_orders(spark, d):
    sup, inv, _ = _loaded(spark, d)
    step = _in_turn(Steps(spark, "load-orders"))
    return E.load_orders(step(W.raw_orders(spark, d), "raw"), sup, inv, AS_OF, step=step)[0]


@register(
    "repair_suppliers",
    [("supplier_code", "VARCHAR"), ("supplier_name", "VARCHAR"), ("notes", "VARCHAR"), ("items_linked", "BIGINT")],
    """
SELECT printf('SUP%03d', (SELECT max(TRY_CAST(substr(Supplier_ID, 4) AS BIGINT)) FROM raw_suppliers)
                         + row_number() OVER (ORDER BY n.name)) AS supplier_code,
       n.name AS supplier_name, 'Auto-created from Inventory migration' AS notes,
       (SELECT COUNT(*) FROM raw_inventory r WHERE r.Supplier_Name = n.name AND COALESCE(r.Item_ID, '') <> '')
         AS items_linked
FROM (SELECT DISTINCT Supplier_Name AS name FROM raw_inventory
      WHERE COALESCE(Supplier_Name, '') <> '' AND Supplier_Name NOT IN (SELECT Supplier_Name FROM raw_suppliers)) n""",
    extra_ctes=RAW_SQL,
    notes="ETL-5 + JOI-8: suppliers named only in inventory are created and linked",
)
def q_repair_suppliers(spark, d):
    sup, inv, _ = _loaded(spark, d)
    all_sup, linked = E.repair_suppliers(W.raw_inventory(spark, d), sup, inv)
    new = all_sup.where(F.col("notes") == E.AUTO_SUPPLIER_NOTE)
    counts = linked.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("items_linked"))
    return new.join(counts, "supplier_id", "left").select(
        "supplier_code", "supplier_name", "notes", F.coalesce("items_linked", F.lit(0)).alias("items_linked")
    )


@register(
    "username_conflicts",
    [("username", "VARCHAR"), ("conflict", "VARCHAR")],
    """
WITH n AS (
  SELECT CASE user_id % 3 WHEN 0 THEN upper(username) WHEN 1 THEN username || '-2' ELSE 'Shared Login' END AS username
  FROM users
)
SELECT n.username, CASE WHEN e.lk IS NOT NULL THEN 'exists' ELSE 'duplicate in batch' END AS conflict
FROM n
LEFT JOIN (SELECT DISTINCT lower(username) AS lk FROM users) e ON lower(n.username) = e.lk
LEFT JOIN (SELECT lower(username) AS lk, COUNT(*) AS c FROM n GROUP BY 1) d ON lower(n.username) = d.lk
WHERE e.lk IS NOT NULL OR d.c > 1""",
    notes="ETL-6: every user submitted again: in capitals (exists), renamed (fine) or under one shared name (duplicate)",
)
def q_username_conflicts(spark, d):
    u = A.users(spark, d)
    third = F.col("user_id") % 3
    new = u.select(F.when(third == 0, F.upper("username")).when(third == 1, F.concat("username", F.lit("-2")))
                   .otherwise("Shared Login").alias("username"))
    return E.username_conflicts(new, u)


@register(
    "assign_item_codes",
    [("SKU", "VARCHAR"), ("item_code", "VARCHAR")],
    """
WITH ex AS (SELECT max(TRY_CAST(substr(Item_ID, 4) AS BIGINT)) AS m FROM raw_inventory
            WHERE starts_with(Item_ID, 'ITM') AND NOT ((TRY_CAST(substr(Item_ID, 4) AS BIGINT) - 1) % 7 = 0))
SELECT SKU, CASE WHEN (TRY_CAST(substr(Item_ID, 4) AS BIGINT) - 1) % 7 = 0
                 THEN printf('ITM%03d', (SELECT m FROM ex) + row_number() OVER (
                        PARTITION BY (TRY_CAST(substr(Item_ID, 4) AS BIGINT) - 1) % 7 = 0 ORDER BY SKU))
                 ELSE Item_ID END AS item_code
FROM raw_inventory""",
    extra_ctes=RAW_SQL,
    notes="ETL-4: items arriving without a code (every 7th) numbered after the highest existing code, in SKU order",
)
def q_assign_item_codes(spark, d):
    raw = W.raw_inventory(spark, d)
    num = F.substring("Item_ID", 4, 20).try_cast("long")
    batch = raw.select("SKU", F.when((num - 1) % 7 == 0, F.lit("")).otherwise(F.col("Item_ID")).alias("item_code"))
    existing = batch.where(F.col("item_code") != "").select("item_code")
    return E.assign_codes(batch, "item_code", existing, "ITM", ["SKU"])
