"""Data-quality rules (DQ-1..7) re-aimed from table constraints to a batch
check job.

Row rules (domain, range, cross-field, NOT NULL, length) are predicates
evaluated in one pass: every rule becomes one element of an array of
violations per row, exploded once - a single scan however many rules.
Uniqueness (DQ-5) is an aggregate with map-side combine; references
(DQ-6) are anti joins against the parent keys. As in SQL, NULL passes a
CHECK (only NOT NULL rules flag NULLs).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.schemas import ACCOUNT_STATUSES, CATEGORIES, ORDER_STATUSES, PAYMENT_METHODS, ROLES

# VARCHAR limits of the typed schema (fixed values).
VARCHAR_LIMITS = {
    "suppliers": {"supplier_code": 20, "supplier_name": 255, "contact_person": 255, "phone": 50, "email": 255},
    "inventory": {"item_code": 20, "category": 50, "item_name": 255, "sku": 100},
    "users": {"user_code": 20, "username": 100, "email": 255, "password_hash": 255, "role": 20,
              "account_status": 20},
    "sales_log": {"transaction_code": 30, "payment_method": 50},
    "restock_orders": {"order_code": 30, "status": 20},
    "activity_log": {"action": 100},
}

DOMAINS = {
    "inventory": {"category": CATEGORIES},
    "users": {"role": ROLES, "account_status": ACCOUNT_STATUSES},
    "sales_log": {"payment_method": PAYMENT_METHODS},
    "restock_orders": {"status": ORDER_STATUSES},
}

RANGES = {
    "inventory": {"quantity_in_stock": (">=", 0), "cost_price": (">=", 0), "selling_price": (">=", 0)},
    "sales_log": {"quantity_sold": (">", 0), "unit_price": (">=", 0)},
    "restock_orders": {"quantity_ordered": (">", 0), "cost_per_unit": (">=", 0)},
}

NOT_NULL = {
    "suppliers": ["supplier_code", "supplier_name"],
    "inventory": ["item_code", "category", "item_name", "quantity_in_stock", "min_stock_level", "cost_price",
                  "selling_price", "date_added"],
    "users": ["user_code", "username", "password_hash", "role", "account_status"],
    "sales_log": ["transaction_code", "sale_date", "sale_time", "item_id", "quantity_sold", "unit_price",
                  "payment_method"],
    "restock_orders": ["order_code", "date_ordered", "supplier_id", "item_id", "quantity_ordered",
                       "cost_per_unit", "status"],
    "activity_log": ["action"],
}

UNIQUE = {
    "suppliers": ["supplier_code"],
    "inventory": ["item_code"],
    "users": ["user_code", "username"],
    "sales_log": ["transaction_code"],
    "restock_orders": ["order_code"],
}

# child table, child column, parent table, parent key, on parent delete
REFERENCES = [
    ("inventory", "supplier_id", "suppliers", "supplier_id", "SET NULL"),
    ("users", "created_by", "users", "user_id", "SET NULL"),
    ("sales_log", "item_id", "inventory", "item_id", "RESTRICT"),
    ("sales_log", "sold_by", "users", "user_id", "SET NULL"),
    ("restock_orders", "supplier_id", "suppliers", "supplier_id", "RESTRICT"),
    ("restock_orders", "item_id", "inventory", "item_id", "RESTRICT"),
    ("activity_log", "user_id", "users", "user_id", "SET NULL"),
]

KEYS = {
    "suppliers": "supplier_code",
    "inventory": "item_code",
    "users": "user_code",
    "sales_log": "transaction_code",
    "restock_orders": "order_code",
    "activity_log": "log_id",
}

VIOLATION_COLS = ["table_name", "rule_id", "column_name", "row_key", "value"]


@dataclass(frozen=True)
class RowRule:
    rule_id: str
    column: str
    violated: Column  # TRUE when the row breaks the rule


def row_rules(table: str, df: DataFrame) -> list[RowRule]:
    cols = set(df.columns)
    rules: list[RowRule] = []
    for c, allowed in DOMAINS.get(table, {}).items():
        if c in cols:
            rules.append(RowRule("DQ-1", c, F.col(c).isNotNull() & ~F.col(c).isin(*allowed)))
    for c, (op, bound) in RANGES.get(table, {}).items():
        if c in cols:
            ok = F.col(c) >= bound if op == ">=" else F.col(c) > bound
            rules.append(RowRule("DQ-2", c, F.col(c).isNotNull() & ~ok))
    if table == "restock_orders" and {"status", "date_received"} <= cols:
        rec = F.col("status") == "Received"
        rules.append(RowRule("DQ-3", "date_received", F.col("status").isNotNull() & (rec != F.col("date_received").isNotNull())))
    for c in NOT_NULL.get(table, []):
        if c in cols:
            rules.append(RowRule("DQ-4", c, F.col(c).isNull()))
    for c, n in VARCHAR_LIMITS.get(table, {}).items():
        if c in cols:
            rules.append(RowRule("DQ-7", c, F.length(F.col(c)) > n))
    return rules


def row_violations(table: str, df: DataFrame, key: str | None = None) -> DataFrame:
    """One pass: an array of the rules each row breaks, exploded."""
    key = key or KEYS[table]
    rules = row_rules(table, df)
    hits = F.array(*[
        F.when(r.violated, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.column).alias("column_name"),
                                    F.col(r.column).cast("string").alias("value")))
        for r in rules
    ])
    return (
        df.select(F.col(key).cast("string").alias("row_key"), F.filter(hits, lambda x: x.isNotNull()).alias("_v"))
        .where(F.size("_v") > 0)
        .select("row_key", F.explode("_v").alias("v"))
        .select(F.lit(table).alias("table_name"), "v.rule_id", "v.column_name", "row_key", "v.value")
    )


def unique_violations(table: str, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """DQ-5: every value of a unique column held by more than one row
    (value = the number of rows holding it)."""
    parts = []
    for c in columns or UNIQUE.get(table, []):
        if c not in df.columns:
            continue
        dup = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        parts.append(dup.select(F.lit(table).alias("table_name"), F.lit("DQ-5").alias("rule_id"),
                                F.lit(c).alias("column_name"), F.col(c).cast("string").alias("row_key"),
                                F.col("_n").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def reference_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """DQ-6: child rows whose non-NULL foreign key has no parent row."""
    parts = []
    for child, col, parent, pkey, _mode in REFERENCES:
        if child not in tables or parent not in tables:
            continue
        if col not in tables[child].columns or pkey not in tables[parent].columns:
            continue
        c = tables[child]
        p = tables[parent].select(F.col(pkey).alias("_pk")).distinct()
        orphans = c.where(F.col(col).isNotNull()).join(p, F.col(col) == F.col("_pk"), "left_anti")
        parts.append(orphans.select(F.lit(child).alias("table_name"), F.lit("DQ-6").alias("rule_id"),
                                    F.lit(col).alias("column_name"),
                                    F.col(KEYS[child]).cast("string").alias("row_key"),
                                    F.col(col).cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations of DQ-1..7 over the given tables."""
    parts = [row_violations(t, df) for t, df in tables.items()]
    parts += [u for u in (unique_violations(t, df) for t, df in tables.items()) if u is not None]
    refs = reference_violations(tables)
    if refs is not None:
        parts.append(refs)
    return reduce(DataFrame.unionByName, parts)


def quarantine(df: DataFrame, violations: DataFrame, table: str, key: str | None = None) -> DataFrame:
    """Rows of ``df`` without any violation (anti join on the row key)."""
    key = key or KEYS[table]
    bad = violations.where(F.col("table_name") == table).select(F.col("row_key").alias("_rk")).distinct()
    return df.join(bad, F.col(key).cast("string") == F.col("_rk"), "left_anti")


def on_parent_delete(child: DataFrame, col: str, deleted_keys: DataFrame, mode: str) -> DataFrame:
    """Effect of deleting parent keys: SET NULL -> child rows with the key
    nulled; RESTRICT -> the child rows that block the delete."""
    d = deleted_keys.select(F.col(deleted_keys.columns[0]).alias("_dk")).distinct()
    if mode == "RESTRICT":
        return child.join(d, F.col(col) == F.col("_dk"), "left_semi")
    j = child.join(d, F.col(col) == F.col("_dk"), "left")
    return j.withColumn(col, F.when(F.col("_dk").isNull(), F.col(col))).drop("_dk")
