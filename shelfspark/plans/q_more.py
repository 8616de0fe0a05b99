"""Ledger side operators (LED-2..8) and data-quality checks (DQ-1..7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import access as X
from shelfspark.operators import ledger as L
from shelfspark.operators import quality as Q
from shelfspark.plans.catalog import AS_OF, register
from shelfspark.plans.oracle import RAW_SQL
from shelfspark.plans.q_ledger import FOLD_CTES
from shelfspark.session import scratch
from shelfspark.sources import adapter as A
from shelfspark.sources import io as IO
from shelfspark.sources import raw as W

# ---------------------------------------------------------------------------
# LED-8 movements recovered from audit text
# ---------------------------------------------------------------------------
_MOVE_SQL = """
SELECT log_id, user_id, created_at, movement, item_code, quantity,
       CASE WHEN movement = 'sale' THEN -quantity ELSE quantity END AS stock_delta
FROM (
  SELECT log_id, user_id, created_at,
         CASE WHEN action = 'RECORD_SALE' THEN 'sale' ELSE 'restock' END AS movement,
         CASE WHEN action = 'RECORD_SALE' THEN regexp_extract(details, '^Sold (\\d+) of (\\S+)$', 2)
              ELSE regexp_extract(details, '^Restocked (-?\\d+) units of (\\S+)$', 2) END AS item_code,
         CAST(CASE WHEN action = 'RECORD_SALE' THEN regexp_extract(details, '^Sold (\\d+) of (\\S+)$', 1)
              ELSE regexp_extract(details, '^Restocked (-?\\d+) units of (\\S+)$', 1) END AS BIGINT) AS quantity
  FROM activity_log
  WHERE (action = 'RECORD_SALE' AND regexp_matches(details, '^Sold (\\d+) of (\\S+)$'))
     OR (action = 'RESTOCK' AND regexp_matches(details, '^Restocked (-?\\d+) units of (\\S+)$'))
) t"""


@register(
    "movements_from_activity",
    [("log_id", "BIGINT"), ("user_id", "BIGINT"), ("created_at", "TIMESTAMP"), ("movement", "VARCHAR"),
     ("item_code", "VARCHAR"), ("quantity", "BIGINT"), ("stock_delta", "BIGINT")],
    _MOVE_SQL,
    notes="LED-8: sales and restocks written only as audit text",
)
def q_movements(spark, d):
    return L.movements_from_activity(A.activity_log(spark, d))


# ---------------------------------------------------------------------------
# LED-3 direct restock on the raw layer (receipts = restocks from the audit)
# ---------------------------------------------------------------------------
@register(
    "direct_restock",
    [("Item_ID", "VARCHAR"), ("Quantity_In_Stock", "VARCHAR"), ("Last_Restocked", "VARCHAR")],
    f"""
SELECT r.Item_ID,
       CASE WHEN g.q IS NULL THEN r.Quantity_In_Stock
            ELSE CAST(COALESCE(CASE WHEN regexp_full_match(trim(r.Quantity_In_Stock), '[+-]?[0-9]+')
                                    THEN TRY_CAST(trim(r.Quantity_In_Stock) AS INTEGER) END, 0) + g.q AS VARCHAR)
       END AS Quantity_In_Stock,
       CASE WHEN g.q IS NULL THEN r.Last_Restocked ELSE '{AS_OF.isoformat()}' END AS Last_Restocked
FROM raw_inventory r LEFT JOIN (
  SELECT item_code, SUM(quantity) AS q FROM ({_MOVE_SQL}) m WHERE movement = 'restock' GROUP BY item_code
) g ON r.Item_ID = g.item_code""",
    extra_ctes=RAW_SQL,
    notes="LED-3: current (0 if unparsable) + received; unknown codes change nothing",
)
def q_direct_restock(spark, d):
    mv = L.movements_from_activity(A.activity_log(spark, d)).where(F.col("movement") == "restock")
    receipts = mv.select("item_code", "quantity", F.lit("Audit").alias("supplier_name"),
                         F.lit(None).cast("decimal(10,2)").alias("cost_per_unit"))
    upd, _orders = L.direct_restock(W.raw_inventory(spark, d), receipts, AS_OF)
    return upd.select("Item_ID", "Quantity_In_Stock", "Last_Restocked")


# ---------------------------------------------------------------------------
# LED-2 receipts on the transition to Received
# ---------------------------------------------------------------------------
_ORDERS_DEDUP_SQL = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY date_ordered DESC, item_id DESC, supplier_id DESC,
                                                             quantity_ordered DESC) AS rn
  FROM restock_orders) t WHERE rn = 1"""


def _orders_unique(spark, d):
    o = A.restock_orders(spark, d)
    return X.dedup_latest(o, "order_id", "date_ordered", ["item_id", "supplier_id", "quantity_ordered"])


@register(
    "restock_receipts",
    [("item_code", "VARCHAR"), ("quantity_in_stock", "INTEGER"), ("last_restocked", "DATE")],
    f"""
SELECT i.item_code, CAST(i.quantity_in_stock + COALESCE(m.q, 0) AS INTEGER) AS quantity_in_stock,
       COALESCE(m.rec, i.last_restocked) AS last_restocked
FROM inventory i LEFT JOIN (
  SELECT item_id, SUM(quantity_ordered) AS q, MAX(date_received) AS rec
  FROM ({_ORDERS_DEDUP_SQL}) o WHERE status = 'Received' AND order_id % 3 = 0 GROUP BY item_id
) m ON i.item_id = m.item_id""",
    notes="LED-2: a third of the Received orders were Pending in the earlier snapshot",
)
def q_restock_receipts(spark, d):
    after = _orders_unique(spark, d)
    before = after.withColumn(
        "status", F.when((F.col("status") == "Received") & (F.col("order_id") % 3 == 0), "Pending").otherwise(F.col("status"))
    )
    return L.apply_receipts(A.inventory(spark, d), before, after).select("item_code", "quantity_in_stock",
                                                                           "last_restocked")


# ---------------------------------------------------------------------------
# LED-4 / LED-5
# ---------------------------------------------------------------------------
@register(
    "apply_updates",
    [("item_code", "VARCHAR"), ("quantity_in_stock", "INTEGER"), ("last_restocked", "DATE")],
    """
SELECT i.item_code, i.quantity_in_stock, COALESCE(c.rec, i.last_restocked) AS last_restocked
FROM inventory i LEFT JOIN (SELECT item_id, MAX(date_received) AS rec FROM restock_orders GROUP BY item_id) c
  ON i.item_id = c.item_id""",
    notes="LED-4: set-based update by key, untouched columns stay",
)
def q_apply_updates(spark, d):
    ch = A.restock_orders(spark, d).groupBy("item_id").agg(F.max("date_received").alias("last_restocked"))
    return L.apply_updates(A.inventory(spark, d), ch, "item_id").select("item_code", "quantity_in_stock",
                                                                         "last_restocked")


@register(
    "apply_deletes",
    [("item_code", "VARCHAR"), ("item_name", "VARCHAR")],
    """
SELECT item_code, item_name FROM inventory
WHERE item_id NOT IN (SELECT item_id FROM sales_log WHERE item_id IS NOT NULL)""",
    notes="LED-5: batch delete by key (the keys of every item that ever sold)",
)
def q_apply_deletes(spark, d):
    keys = A.sales_log(spark, d).select("item_id").distinct()
    return L.apply_deletes(A.inventory(spark, d), keys, "item_id").select("item_code", "item_name")


# ---------------------------------------------------------------------------
# LED-6 receipt lines, LED-7 reconciliation (both need the LED-1 fold)
# ---------------------------------------------------------------------------
@register(
    "sale_receipts",
    [("transaction_id", "BIGINT"), ("item_id", "BIGINT"), ("item", "VARCHAR"), ("qty", "INTEGER"),
     ("total", "DECIMAL(18,2)"), ("remaining", "BIGINT")],
    """
SELECT o.transaction_id, o.item_id, i.item_name AS item, o.quantity_sold AS qty,
       o.quantity_sold * i.selling_price AS total, f.after AS remaining
FROM ordered o JOIN fold f ON o.item_id = f.item_id AND o.rn = f.rn
JOIN inventory i ON o.item_id = i.item_id
WHERE f.after < f.avail""",
    extra_ctes=FOLD_CTES,
    notes="LED-6: accepted sales as receipt lines",
)
def q_sale_receipts(spark, d):
    inv = A.inventory(spark, d)
    return L.sale_receipts(L.apply_sales(inv, A.sales_log(spark, d)), inv)


@register(
    "reconcile",
    [("item_id", "BIGINT"), ("opening", "BIGINT"), ("received", "BIGINT"), ("sold", "BIGINT"),
     ("expected", "BIGINT"), ("recorded", "BIGINT"), ("difference", "BIGINT")],
    """
SELECT i.item_id, CAST(i.quantity_in_stock AS BIGINT) AS opening, COALESCE(r.q, 0) AS received,
       COALESCE(s.q, 0) AS sold, i.quantity_in_stock + COALESCE(r.q, 0) - COALESCE(s.q, 0) AS expected,
       i.quantity_in_stock - COALESCE(s.q, 0) AS recorded,
       (i.quantity_in_stock - COALESCE(s.q, 0)) - (i.quantity_in_stock + COALESCE(r.q, 0) - COALESCE(s.q, 0))
         AS difference
FROM inventory i
LEFT JOIN (SELECT item_id, SUM(avail - after) AS q FROM fold GROUP BY item_id) s ON i.item_id = s.item_id
LEFT JOIN (SELECT item_id, SUM(quantity_ordered) AS q FROM restock_orders WHERE status = 'Received'
           GROUP BY item_id) r ON i.item_id = r.item_id""",
    extra_ctes=FOLD_CTES,
    notes="LED-7: opening + received - accepted sales vs stock recorded after the sales only",
)
def q_reconcile(spark, d):
    inv = A.inventory(spark, d)
    led = L.apply_sales(inv, A.sales_log(spark, d))
    recorded = L.closing_stock(inv, led)
    return L.reconcile(inv, led, A.restock_orders(spark, d), recorded)


# ---------------------------------------------------------------------------
# DQ-1..7
# ---------------------------------------------------------------------------
def _dq_oracle() -> str:
    parts = []
    tables = ["suppliers", "inventory", "users", "sales_log", "restock_orders", "activity_log"]
    for t in tables:
        for c, allowed in Q.DOMAINS.get(t, {}).items():
            vals = ", ".join("'" + v + "'" for v in allowed)
            parts.append(f"SELECT '{t}' AS table_name, 'DQ-1' AS rule_id, '{c}' AS column_name, COUNT(*) AS n "
                         f"FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN ({vals})")
        for c, (op, b) in Q.RANGES.get(t, {}).items():
            parts.append(f"SELECT '{t}', 'DQ-2', '{c}', COUNT(*) FROM {t} WHERE {c} IS NOT NULL AND NOT ({c} {op} {b})")
        if t == "restock_orders":
            parts.append("SELECT 'restock_orders', 'DQ-3', 'date_received', COUNT(*) FROM restock_orders "
                         "WHERE status IS NOT NULL AND (status = 'Received') <> (date_received IS NOT NULL)")
        for c in Q.NOT_NULL.get(t, []):
            parts.append(f"SELECT '{t}', 'DQ-4', '{c}', COUNT(*) FROM {t} WHERE {c} IS NULL")
        for c, n in Q.VARCHAR_LIMITS.get(t, {}).items():
            parts.append(f"SELECT '{t}', 'DQ-7', '{c}', COUNT(*) FROM {t} WHERE length({c}) > {n}")
        for c in Q.UNIQUE.get(t, []):
            parts.append(f"SELECT '{t}', 'DQ-5', '{c}', COUNT(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL "
                         f"GROUP BY {c} HAVING COUNT(*) > 1) d")
    for child, col, parent, pkey, _ in Q.REFERENCES:
        parts.append(f"SELECT '{child}', 'DQ-6', '{col}', COUNT(*) FROM {child} c WHERE c.{col} IS NOT NULL AND "
                     f"NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pkey} = c.{col})")
    head = "SELECT CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR) AS rule_id, " \
           "CAST(NULL AS VARCHAR) AS column_name, CAST(0 AS BIGINT) AS n WHERE false"
    parts.insert(0, head)
    return "SELECT table_name, rule_id, column_name, SUM(n) AS violations FROM (\n" + \
        "\nUNION ALL ".join(parts) + "\n) v GROUP BY table_name, rule_id, column_name HAVING SUM(n) > 0"


@register(
    "dq_violation_summary",
    [("table_name", "VARCHAR"), ("rule_id", "VARCHAR"), ("column_name", "VARCHAR"), ("violations", "BIGINT")],
    _dq_oracle(),
    notes="DQ-1..7 over the six model tables: violations per rule and column",
)
def q_dq_summary(spark, d):
    # The job validates the written model (as in production: derive once,
    # then each rule family scans the stored tables instead of re-deriving
    # sales from lineitem x orders per family).
    root = scratch(spark, "model")
    paths = IO.materialize_model(spark, d, root)
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    tables["sales_log"] = tables["sales_log"].drop("sale_month")
    tables["restock_orders"] = tables["restock_orders"].drop("order_month")
    v = Q.validate(tables)
    return v.groupBy("table_name", "rule_id", "column_name").agg(F.count(F.lit(1)).alias("violations"))


@register(
    "dq_duplicate_codes",
    [("table_name", "VARCHAR"), ("rule_id", "VARCHAR"), ("column_name", "VARCHAR"), ("row_key", "VARCHAR"),
     ("value", "VARCHAR")],
    """
SELECT 'sales_log' AS table_name, 'DQ-5' AS rule_id, 'transaction_code' AS column_name,
       transaction_code AS row_key, CAST(COUNT(*) AS VARCHAR) AS value
FROM sales_log WHERE transaction_code IS NOT NULL GROUP BY transaction_code HAVING COUNT(*) > 1
UNION ALL
SELECT 'restock_orders', 'DQ-5', 'order_code', order_code, CAST(COUNT(*) AS VARCHAR)
FROM restock_orders WHERE order_code IS NOT NULL GROUP BY order_code HAVING COUNT(*) > 1""",
    notes="DQ-5 detail: every duplicated code with its row count",
)
def q_dq_duplicates(spark, d):
    a = Q.unique_violations("sales_log", A.sales_log(spark, d))
    b = Q.unique_violations("restock_orders", A.restock_orders(spark, d))
    return a.unionByName(b)


@register(
    "dq_clean_orders",
    [("order_code", "VARCHAR"), ("status", "VARCHAR"), ("quantity_ordered", "INTEGER")],
    """
SELECT order_code, status, quantity_ordered FROM restock_orders
WHERE order_code NOT IN (SELECT order_code FROM restock_orders GROUP BY order_code HAVING COUNT(*) > 1)""",
    notes="quarantine: orders without any violation (duplicated codes held back)",
)
def q_dq_clean_orders(spark, d):
    o = A.restock_orders(spark, d)
    tables = {"restock_orders": o, "suppliers": A.suppliers(spark, d), "inventory": A.inventory(spark, d)}
    viol = Q.validate(tables)
    return Q.quarantine(o, viol, "restock_orders").select("order_code", "status", "quantity_ordered")


def _dirty_orders(spark, d):
    """Restock orders with every rule broken on some rows, by the order's number."""
    o, k = A.restock_orders(spark, d), F.col("order_id")
    return o.withColumns({
        "status": F.when(k % 97 == 0, "Lost").when(k % 83 == 0, "Pending").otherwise(F.col("status")),
        "quantity_ordered": F.when(k % 89 == 0, 0).otherwise(F.col("quantity_ordered")),
        "cost_per_unit": F.when(k % 79 == 0, -F.col("cost_per_unit")).otherwise(F.col("cost_per_unit")).cast("decimal(10,2)"),
        "date_ordered": F.when(k % 73 != 0, F.col("date_ordered")),
        "supplier_id": F.when(k % 71 == 0, -1).otherwise(F.col("supplier_id")),
        "order_code": F.when(k % 67 == 0, F.repeat(F.col("order_code"), 3)).otherwise(F.col("order_code")),
    })


@register(
    "dq_every_rule",
    [("rule_id", "VARCHAR"), ("column_name", "VARCHAR"), ("row_key", "VARCHAR"), ("value", "VARCHAR")],
    """
WITH dirty AS (
  SELECT order_id, item_id, date_received,
         CASE WHEN order_id % 97 = 0 THEN 'Lost' WHEN order_id % 83 = 0 THEN 'Pending' ELSE status END AS status,
         CASE WHEN order_id % 89 = 0 THEN 0 ELSE quantity_ordered END AS quantity,
         CAST(CASE WHEN order_id % 79 = 0 THEN -cost_per_unit ELSE cost_per_unit END AS DECIMAL(10,2)) AS cost,
         CASE WHEN order_id % 73 <> 0 THEN date_ordered END AS ordered,
         CASE WHEN order_id % 71 = 0 THEN -1 ELSE supplier_id END AS supplier,
         CASE WHEN order_id % 67 = 0 THEN repeat(order_code, 3) ELSE order_code END AS code
  FROM restock_orders
)
SELECT 'DQ-1' AS rule_id, 'status' AS column_name, code AS row_key, status AS value FROM dirty
WHERE status NOT IN ('Pending', 'Received', 'Cancelled')
UNION ALL SELECT 'DQ-2', 'quantity_ordered', code, CAST(quantity AS VARCHAR) FROM dirty WHERE quantity <= 0
UNION ALL SELECT 'DQ-2', 'cost_per_unit', code, CAST(cost AS VARCHAR) FROM dirty WHERE cost < 0
UNION ALL SELECT 'DQ-3', 'date_received', code, CAST(date_received AS VARCHAR) FROM dirty
WHERE (status = 'Received' AND date_received IS NULL) OR (status <> 'Received' AND date_received IS NOT NULL)
UNION ALL SELECT 'DQ-4', 'date_ordered', code, NULL FROM dirty WHERE ordered IS NULL
UNION ALL SELECT 'DQ-5', 'order_code', code, CAST(count(*) AS VARCHAR) FROM dirty GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'DQ-6', 'supplier_id', code, CAST(supplier AS VARCHAR) FROM dirty
WHERE supplier NOT IN (SELECT supplier_id FROM suppliers)
UNION ALL SELECT 'DQ-7', 'order_code', code, code FROM dirty WHERE length(code) > 30""",
    notes="DQ-1..7 on orders of which some break each rule",
)
def q_dq_every_rule(spark, d):
    tables = {"restock_orders": _dirty_orders(spark, d), "suppliers": A.suppliers(spark, d), "inventory": A.inventory(spark, d)}
    v = Q.validate(tables).where(F.col("table_name") == "restock_orders")
    return v.select("rule_id", "column_name", "row_key", "value")


@register(
    "parent_delete_effects",
    [("child", "VARCHAR"), ("row_key", "VARCHAR"), ("supplier_id", "BIGINT")],
    """
SELECT 'inventory' AS child, item_code AS row_key, CASE WHEN supplier_id % 5 <> 0 THEN supplier_id END AS supplier_id
FROM inventory
UNION ALL SELECT 'restock_orders', order_code, supplier_id FROM restock_orders WHERE supplier_id % 5 = 0""",
    notes="DQ-6: deleting every fifth supplier sets items' keys to NULL and is blocked by orders",
)
def q_parent_delete_effects(spark, d):
    gone = A.suppliers(spark, d).where(F.col("supplier_id") % 5 == 0).select("supplier_id")
    items = Q.on_parent_delete(A.inventory(spark, d), "supplier_id", gone, "SET NULL")
    blocked = Q.on_parent_delete(A.restock_orders(spark, d), "supplier_id", gone, "RESTRICT")
    return items.select(F.lit("inventory").alias("child"), F.col("item_code").alias("row_key"), "supplier_id").unionByName(
        blocked.select(F.lit("restock_orders").alias("child"), F.col("order_code").alias("row_key"), "supplier_id"))
