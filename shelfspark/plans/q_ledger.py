"""Stock ledger queries (LED-*) over the adapted driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import ledger as L
from shelfspark.plans.catalog import register
from shelfspark.sources import adapter as A

# Sequential fold of the stock triggers, one row per sale, for all items at
# once: the oracle of LED-1 (independent of the prefix-sum decomposition).
FOLD_CTES = """
ordered AS MATERIALIZED (
  SELECT s.item_id, s.transaction_id, s.line_no, s.sale_date, s.sale_time, s.quantity_sold,
         CAST(i.quantity_in_stock AS BIGINT) AS opening,
         row_number() OVER (PARTITION BY s.item_id
                            ORDER BY s.sale_date, s.sale_time, s.transaction_id, s.line_no, s.quantity_sold) AS rn
  FROM sales_log s JOIN inventory i ON s.item_id = i.item_id
),
fold AS (
  SELECT item_id, rn, opening AS avail,
         opening - CASE WHEN quantity_sold > 0 AND quantity_sold <= opening THEN quantity_sold ELSE 0 END AS after
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.item_id, o.rn, f.after AS avail,
         f.after - CASE WHEN o.quantity_sold > 0 AND o.quantity_sold <= f.after THEN o.quantity_sold ELSE 0 END
  FROM fold f JOIN ordered o ON o.item_id = f.item_id AND o.rn = f.rn + 1
)
"""

_ACCEPT_COLS = [
    ("item_id", "BIGINT"), ("transaction_id", "BIGINT"), ("line_no", "INTEGER"), ("sale_date", "DATE"),
    ("sale_time", "VARCHAR"), ("quantity_sold", "INTEGER"), ("accepted", "BOOLEAN"), ("reason", "VARCHAR"),
    ("available", "BIGINT"), ("stock_after", "BIGINT"),
]


@register(
    "sale_acceptance",
    _ACCEPT_COLS,
    """
SELECT o.item_id, o.transaction_id, o.line_no, o.sale_date, o.sale_time, o.quantity_sold,
       f.after < f.avail AS accepted,
       CASE WHEN f.after < f.avail THEN NULL
            WHEN o.quantity_sold <= 0 THEN 'invalid quantity'
            ELSE 'insufficient stock' END AS reason,
       f.avail AS available, f.after AS stock_after
FROM ordered o JOIN fold f ON o.item_id = f.item_id AND o.rn = f.rn
UNION ALL
SELECT s.item_id, s.transaction_id, s.line_no, s.sale_date, s.sale_time, s.quantity_sold,
       false, 'unknown item', NULL, NULL
FROM sales_log s WHERE s.item_id IS NULL OR s.item_id NOT IN (SELECT item_id FROM inventory)""",
    extra_ctes=FOLD_CTES,
    notes="LED-1 greedy acceptance per sale; oracle is a sequential recursive fold",
)
def q_sale_acceptance(spark, d):
    return L.apply_sales(A.inventory(spark, d), A.sales_log(spark, d))


@register(
    "closing_stock",
    [("item_code", "VARCHAR"), ("opening", "BIGINT"), ("accepted_sales", "BIGINT"), ("refused_sales", "BIGINT"),
     ("units_sold", "BIGINT"), ("closing", "BIGINT")],
    """
SELECT i.item_code, CAST(i.quantity_in_stock AS BIGINT) AS opening,
       COALESCE(SUM(CASE WHEN f.after < f.avail THEN 1 ELSE 0 END), 0) AS accepted_sales,
       COALESCE(SUM(CASE WHEN f.after >= f.avail THEN 1 ELSE 0 END), 0) AS refused_sales,
       COALESCE(SUM(f.avail - f.after), 0) AS units_sold,
       i.quantity_in_stock - COALESCE(SUM(f.avail - f.after), 0) AS closing
FROM inventory i LEFT JOIN fold f ON i.item_id = f.item_id
GROUP BY i.item_id, i.item_code, i.quantity_in_stock""",
    extra_ctes=FOLD_CTES,
    notes="LED-1 item level: stock after applying every sale in order",
)
def q_closing_stock(spark, d):
    s = L.stock_summary(A.inventory(spark, d), A.sales_log(spark, d))
    return s.select("item_code", "opening", "accepted_sales", "refused_sales", "units_sold", "closing")
