"""Filters, projections, visibility, sessions and lockout queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfspark.operators import access as X
from shelfspark.operators import etl as E
from shelfspark.operators import search as SE
from shelfspark.operators import sessions as S
from shelfspark.plans.catalog import AS_OF, AS_OF_SQL, M2, register
from shelfspark.plans.oracle import RAW_SQL, clean_date_sql
from shelfspark.session import scratch
from shelfspark.sources import adapter as A
from shelfspark.sources import raw as W

SEARCH_TERM = "red"


@register(
    "inventory_search",
    [("item_code", "VARCHAR"), ("item_name", "VARCHAR"), ("category", "VARCHAR"), ("supplier_name", "VARCHAR")],
    f"""
SELECT i.item_code, i.item_name, i.category, COALESCE(s.supplier_name, 'Unknown') AS supplier_name
FROM inventory i LEFT JOIN suppliers s ON i.supplier_id = s.supplier_id
WHERE contains(lower(i.item_name), '{SEARCH_TERM}') OR contains(lower(i.item_code), '{SEARCH_TERM}')
   OR contains(lower(i.category), '{SEARCH_TERM}')
   OR contains(lower(COALESCE(s.supplier_name, 'Unknown')), '{SEARCH_TERM}')""",
    notes="FLT-1 over JOI-1 (supplier name, Unknown when missing)",
)
def q_inventory_search(spark, d):
    e = X.enrich_inventory(A.inventory(spark, d), A.suppliers(spark, d))
    return X.search_items(e, SEARCH_TERM).select("item_code", "item_name", "category", "supplier_name")


TEXT_TERMS = ["small", "economy"]


@register(
    "text_match",
    [("item_code", "VARCHAR"), ("item_name", "VARCHAR"), ("description", "VARCHAR")],
    """
SELECT item_code, item_name, description FROM (
  SELECT *, regexp_split_to_array(lower(concat_ws(' ', item_name, COALESCE(description, ''))),
                                  '[^\\p{L}\\p{N}]+') AS toks
  FROM inventory) t
WHERE list_contains(toks, 'small') AND list_contains(toks, 'economy')""",
    notes="FLT-2 token match (all terms)",
)
def q_text_match(spark, d):
    return X.text_match(A.inventory(spark, d), TEXT_TERMS).select("item_code", "item_name", "description")


@register(
    "text_search_stems",
    [("item_id", "BIGINT"), ("item_code", "VARCHAR"), ("item_name", "VARCHAR"), ("n_words", "BIGINT")],
    """
SELECT item_id, item_code, item_name, economies + polishes AS n_words FROM (
  SELECT *, len(list_filter(toks, lambda t: t IN ('economy', 'economies'))) AS economies,
         len(list_filter(toks, lambda t: t IN ('polish', 'polishes', 'polished', 'polishing'))) AS polishes
  FROM (SELECT *, regexp_split_to_array(lower(concat_ws(' ', item_name, COALESCE(description, ''))), '[^\\p{L}\\p{N}]+') AS toks
        FROM inventory) t) n
WHERE economies > 0 AND polishes > 0""",
    notes="FLT-2 with stems: an inverted index written in buckets, the query's stems read from it",
)
def q_text_search_stems(spark, d):
    items = A.inventory(spark, d)
    path = SE.write_index(items, f"{scratch(spark, 'text-index')}/postings")
    return SE.search(items, path, "the economies, polishing").select("item_id", "item_code", "item_name", "n_words")


@register(
    "stock_status",
    [("item_code", "VARCHAR"), ("quantity_in_stock", "INTEGER"), ("min_stock_level", "INTEGER"),
     ("stock_status", "VARCHAR")],
    """
SELECT item_code, quantity_in_stock, min_stock_level,
       CASE WHEN quantity_in_stock <= min_stock_level THEN 'LOW STOCK' ELSE 'OK' END AS stock_status
FROM inventory""",
    notes="FLT-4",
)
def q_stock_status(spark, d):
    from shelfspark.operators.raw_reports import stock_status
    return stock_status(A.inventory(spark, d)).select("item_code", "quantity_in_stock", "min_stock_level", "stock_status")


@register(
    "sales_between",
    [("transaction_code", "VARCHAR"), ("item_id", "BIGINT"), ("sale_date", "DATE"), ("quantity_sold", "INTEGER")],
    """
SELECT transaction_code, item_id, sale_date, quantity_sold FROM sales_log
WHERE sale_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'""",
    notes="FLT-7 inclusive date range",
)
def q_sales_between(spark, d):
    s = X.between_dates(A.sales_log(spark, d), dt.date(1997, 1, 1), dt.date(1997, 3, 31))
    return s.select("transaction_code", "item_id", "sale_date", "quantity_sold")


@register(
    "item_lookup",
    [("item_id", "BIGINT"), ("item_code", "VARCHAR"), ("item_name", "VARCHAR"), ("quantity_in_stock", "INTEGER")],
    """
SELECT item_id, item_code, item_name, quantity_in_stock FROM inventory WHERE item_code = 'ITM042'""",
    notes="FLT-6 point lookup by code (a 36-character key would select by id)",
)
def q_item_lookup(spark, d):
    return X.by_key(A.inventory(spark, d), "ITM042", "item_id", "item_code").select(
        "item_id", "item_code", "item_name", "quantity_in_stock")


@register(
    "visible_activity_counts",
    [("user_id", "BIGINT"), ("role", "VARCHAR"), ("visible_rows", "BIGINT")],
    """
SELECT u.user_id, u.role,
       CASE WHEN u.role = 'Admin' THEN (SELECT COUNT(*) FROM activity_log)
            WHEN u.role = 'Staff' THEN COALESCE(o.n, 0) ELSE 0 END AS visible_rows
FROM users u LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM activity_log GROUP BY user_id) o
  ON u.user_id = o.user_id""",
    notes="FLT-8 row visibility of activity_log for every user",
)
def q_visible_activity_counts(spark, d):
    return X.visible_counts(A.activity_log(spark, d), "activity_log", A.users(spark, d))


_ACTION_PERMISSION = {"RESTOCK": "restock", "VIEW_REPORT": "view_reports", "RECORD_SALE": "edit_item",
                      "LOGIN": "delete_item", "LOGIN_FAILED": "manage_users"}


@register(
    "permission_checks",
    [("log_id", "BIGINT"), ("user_id", "BIGINT"), ("permission", "VARCHAR"), ("allowed", "BOOLEAN")],
    """
SELECT a.log_id, a.user_id, a.permission,
       COALESCE((u.role = 'Admin') OR (u.role = 'Staff' AND a.permission IN ('add_item', 'edit_item', 'restock',
                                                                         'view_reports')), false) AS allowed
FROM (SELECT log_id, user_id, CASE action WHEN 'RESTOCK' THEN 'restock' WHEN 'VIEW_REPORT' THEN 'view_reports'
                                          WHEN 'RECORD_SALE' THEN 'edit_item' WHEN 'LOGIN' THEN 'delete_item'
                                          WHEN 'LOGIN_FAILED' THEN 'manage_users' END AS permission
      FROM activity_log WHERE action IN ('RESTOCK', 'VIEW_REPORT', 'RECORD_SALE', 'LOGIN', 'LOGIN_FAILED')) a
LEFT JOIN users u ON a.user_id = u.user_id""",
    notes="FLT-9: audit actions, two of them reserved to admins, checked against the role's permissions",
)
def q_permission_checks(spark, d):
    log = A.activity_log(spark, d).where(F.col("action").isin(*_ACTION_PERMISSION))
    perm = F.lit(None).cast("string")
    for a, p in _ACTION_PERMISSION.items():
        perm = F.when(F.col("action") == a, p).otherwise(perm)
    req = log.select("log_id", "user_id", perm.alias("permission"))
    return X.allowed(req, A.users(spark, d), X.permission_table(spark)).select(
        "log_id", "user_id", "permission", "allowed")


@register(
    "dedup_latest_sales",
    [("transaction_code", "VARCHAR"), ("sale_date", "DATE"), ("sale_time", "VARCHAR"), ("item_id", "BIGINT"),
     ("quantity_sold", "INTEGER"), ("unit_price", M2)],
    """
SELECT transaction_code, sale_date, sale_time, item_id, quantity_sold, unit_price FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_code
                               ORDER BY sale_date DESC, sale_time DESC, item_id DESC, quantity_sold DESC,
                                        unit_price DESC) AS rn
  FROM sales_log) t WHERE rn = 1""",
    notes="WIN-2: newest row per duplicated transaction code",
)
def q_dedup_latest_sales(spark, d):
    s = A.sales_log(spark, d).select("transaction_code", "sale_date", "sale_time", "item_id", "quantity_sold",
                                     "unit_price")
    return X.dedup_latest(s, "transaction_code", "sale_date", ["sale_time", "item_id", "quantity_sold", "unit_price"])


@register(
    "legacy_inventory",
    [("Item_ID", "VARCHAR"), ("_uuid", "BIGINT"), ("Category", "VARCHAR"), ("Item_Name", "VARCHAR"),
     ("Quantity_In_Stock", "INTEGER"), ("Selling_Price", M2), ("Profit_Margin", M2), ("supplier_id", "BIGINT")],
    """
SELECT item_code AS Item_ID, item_id AS _uuid, category AS Category, item_name AS Item_Name,
       quantity_in_stock AS Quantity_In_Stock, selling_price AS Selling_Price, profit_margin AS Profit_Margin,
       supplier_id
FROM inventory""",
    notes="PRJ-1 database names -> legacy headers, unmapped columns kept",
)
def q_legacy_inventory(spark, d):
    return X.to_legacy(A.inventory(spark, d))


@register(
    "public_users",
    [("user_code", "VARCHAR"), ("username", "VARCHAR"), ("role", "VARCHAR"), ("account_status", "VARCHAR")],
    """SELECT user_code, username, role, account_status FROM users""",
    notes="PRJ-3 (password hash dropped)",
)
def q_public_users(spark, d):
    return X.public_users(A.users(spark, d))


@register(
    "item_defaults",
    [("item_code", "VARCHAR"), ("description", "VARCHAR"), ("sku", "VARCHAR"), ("last_restocked", "DATE")],
    f"""
SELECT Item_ID AS item_code, COALESCE(Description, '') AS description, COALESCE(SKU, '') AS sku,
       COALESCE({clean_date_sql('Last_Restocked')}, {AS_OF_SQL}) AS last_restocked
FROM raw_inventory WHERE COALESCE(Item_Name, '') <> ''""",
    extra_ctes=RAW_SQL,
    notes="PRJ-4 new-item defaults applied to loaded items",
)
def q_item_defaults(spark, d):
    sup, _ = E.load_suppliers(W.raw_suppliers(spark, d))
    inv, _ = E.load_inventory(W.raw_inventory(spark, d), sup, AS_OF)
    return X.with_item_defaults(inv, AS_OF)


# ---------------------------------------------------------------------------
# Sessions (SES-1..3) and lockout (ST-4 batch)
# ---------------------------------------------------------------------------
@register(
    "user_sessions",
    [("user_id", "BIGINT"), ("session_no", "BIGINT"), ("session_start", "TIMESTAMP"),
     ("last_activity", "TIMESTAMP"), ("logout_at", "TIMESTAMP"), ("warning_at", "TIMESTAMP"), ("events", "BIGINT")],
    """
SELECT user_id, session_no, MIN(created_at) AS session_start, MAX(created_at) AS last_activity,
       MAX(created_at) + INTERVAL 24 HOUR AS logout_at, MAX(created_at) + INTERVAL 24 HOUR - INTERVAL 10 MINUTE
       AS warning_at, COUNT(*) AS events
FROM (
  SELECT user_id, created_at, SUM(new) OVER (PARTITION BY user_id ORDER BY created_at
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
  FROM (SELECT user_id, created_at,
               CASE WHEN lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) IS NULL
                      OR created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at)
                         >= INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new
        FROM activity_log WHERE user_id IS NOT NULL) f
) s GROUP BY user_id, session_no""",
    notes="SES-1 24-hour inactivity sessions",
)
def q_user_sessions(spark, d):
    return S.sessions(A.activity_log(spark, d))


@register(
    "expired_activity",
    [("log_id", "BIGINT"), ("user_id", "BIGINT"), ("created_at", "TIMESTAMP"), ("action", "VARCHAR"),
     ("last_login", "TIMESTAMP"), ("unauthorised", "BOOLEAN")],
    """
SELECT log_id, user_id, created_at, action, last_login,
       last_login IS NULL OR created_at - last_login > INTERVAL 8 HOUR AS unauthorised
FROM (
  SELECT *, MAX(CASE WHEN action = 'LOGIN' THEN created_at END)
              OVER (PARTITION BY user_id ORDER BY created_at, CASE WHEN action = 'LOGIN' THEN 0 ELSE 1 END, log_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_login
  FROM activity_log WHERE user_id IS NOT NULL) t
WHERE action <> 'LOGIN'""",
    notes="SES-2 activity more than 8 hours after the latest login",
)
def q_expired_activity(spark, d):
    return S.expired_activity(A.activity_log(spark, d))


@register(
    "last_login",
    [("user_id", "BIGINT"), ("last_login", "TIMESTAMP")],
    """SELECT user_id, MAX(created_at) AS last_login FROM activity_log WHERE action = 'LOGIN' GROUP BY user_id""",
    notes="SES-3",
)
def q_last_login(spark, d):
    return S.last_login(A.activity_log(spark, d))


LOCK_S = 24 * 3600

LOCK_CTES = f"""
att AS MATERIALIZED (
  SELECT a.attempt_id, lower(a.username) AS u, epoch_us(a.ts) AS us, a.success,
         COALESCE(us2.account_status = 'Active', true) AS active,
         row_number() OVER (PARTITION BY lower(a.username) ORDER BY epoch_us(a.ts), a.attempt_id) AS rn
  FROM login_attempts a LEFT JOIN users us2 ON a.user_id = us2.user_id
),
lk AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS attempt_id, CAST(NULL AS VARCHAR) AS outcome,
         0 AS cnt, CAST(NULL AS BIGINT) AS until FROM att
  UNION ALL
  SELECT a.u, a.rn, a.attempt_id,
    CASE WHEN s.until IS NOT NULL AND a.us < s.until THEN 'refused'
         WHEN NOT a.active THEN 'inactive'
         WHEN a.success THEN 'success'
         WHEN (CASE WHEN s.until IS NOT NULL THEN 0 ELSE s.cnt END) + 1 >= 5 THEN 'locked'
         ELSE 'failure' END,
    CASE WHEN s.until IS NOT NULL AND a.us < s.until THEN s.cnt
         WHEN NOT a.active THEN (CASE WHEN s.until IS NOT NULL THEN 0 ELSE s.cnt END)
         WHEN a.success THEN 0
         ELSE (CASE WHEN s.until IS NOT NULL THEN 0 ELSE s.cnt END) + 1 END,
    CASE WHEN s.until IS NOT NULL AND a.us < s.until THEN s.until
         WHEN NOT a.active OR a.success THEN NULL
         WHEN (CASE WHEN s.until IS NOT NULL THEN 0 ELSE s.cnt END) + 1 >= 5 THEN a.us + {LOCK_S * 1_000_000}
         ELSE NULL END
  FROM lk s JOIN att a ON a.u = s.u AND a.rn = s.rn + 1
)
"""


@register(
    "login_lockouts",
    [("attempt_id", "BIGINT"), ("username", "VARCHAR"), ("success", "BOOLEAN"), ("outcome", "VARCHAR"),
     ("failures", "INTEGER")],
    """
SELECT l.attempt_id, a.username, a.success, l.outcome, l.cnt AS failures
FROM lk l JOIN login_attempts a ON l.attempt_id = a.attempt_id WHERE l.rn > 0""",
    extra_ctes=LOCK_CTES,
    notes="ST-4 batch: 5 failures in a row lock the username (lock 1 day on this data)",
)
def q_login_lockouts(spark, d):
    att = A.login_attempts(spark, d)
    act = A.users(spark, d).select("user_id", (F.col("account_status") == "Active").alias("active"))
    att = att.join(act, "user_id", "left")
    return S.lockouts(att, lock_s=LOCK_S).select("attempt_id", "username", "success", "outcome", "failures")


_WRITES = [("inventory", "UPDATE"), ("suppliers", "INSERT"), ("sales_log", "INSERT"), ("sales_log", "DELETE"),
           ("restock_orders", "UPDATE"), ("users", "UPDATE"), ("activity_log", "INSERT"), ("activity_log", "UPDATE")]


@register(
    "write_checks",
    [("table_name", "VARCHAR"), ("action", "VARCHAR"), ("log_id", "BIGINT"), ("allowed", "BOOLEAN")],
    """
WITH asked AS (
  SELECT a.log_id, a.user_id AS row_owner, CASE WHEN a.log_id % 3 = 0 THEN a.user_id + 1 ELSE a.user_id END AS by_user
  FROM activity_log a
), named AS (
  SELECT q.*, u.role, row_owner = by_user AS own FROM asked q LEFT JOIN users u ON u.user_id = q.by_user
), wanted AS (
  SELECT unnest(['inventory/UPDATE', 'suppliers/INSERT', 'sales_log/INSERT', 'sales_log/DELETE', 'restock_orders/UPDATE',
                 'users/UPDATE', 'activity_log/INSERT', 'activity_log/UPDATE']) AS w
)
SELECT split_part(w, '/', 1) AS table_name, split_part(w, '/', 2) AS action, log_id,
       coalesce(role = 'Admin', false)
       OR (coalesce(role = 'Staff', false) AND w IN ('inventory/UPDATE', 'sales_log/INSERT', 'restock_orders/UPDATE'))
       OR (coalesce(role = 'Staff', false) AND w = 'users/UPDATE' AND coalesce(own, false))
       OR (w = 'activity_log/INSERT' AND coalesce(own, false)) AS allowed
FROM named, wanted""",
    notes="FLT-8 writes: every audit row as a request on each table, a third of them on another user's row",
)
def q_write_checks(spark, d):
    asked = A.activity_log(spark, d).select(
        "log_id", "user_id", F.when(F.col("log_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("by_user"))
    users = A.users(spark, d)
    parts = [X.write_allowed(asked, t, a, users).select(F.lit(t).alias("table_name"), F.lit(a).alias("action"), "log_id", "allowed")
             for t, a in _WRITES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(
    "visible_activity",
    [("log_id", "BIGINT"), ("user_id", "BIGINT"), ("viewer", "BIGINT")],
    """
SELECT a.log_id, a.user_id, v.viewer
FROM activity_log a, (SELECT unnest([1, 2, 3, -1]) AS viewer) v
WHERE (SELECT max(role) FROM users u WHERE u.user_id = v.viewer) = 'Admin'
   OR ((SELECT max(role) FROM users u WHERE u.user_id = v.viewer) = 'Staff' AND a.user_id = v.viewer)""",
    notes="FLT-8: the audit rows that three users and an unknown one may read",
)
def q_visible_activity(spark, d):
    log, users = A.activity_log(spark, d).select("log_id", "user_id"), A.users(spark, d)
    parts = [X.visible_rows(log, "activity_log", users, v).withColumn("viewer", F.lit(v)) for v in (1, 2, 3, -1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register(
    "generated_columns",
    [("transaction_id", "BIGINT"), ("line_no", "INTEGER"), ("total_amount", "DECIMAL(12,2)")],
    """SELECT transaction_id, line_no, CAST(quantity_sold * (unit_price + 1) AS DECIMAL(12,2)) AS total_amount FROM sales_log""",
    notes="PRJ-2: totals recomputed after a price change",
)
def q_generated_columns(spark, d):
    changed = A.sales_log(spark, d).withColumn("unit_price", (F.col("unit_price") + 1).cast("decimal(10,2)"))
    return X.with_generated(changed, "sales_log").select("transaction_id", "line_no", "total_amount")
