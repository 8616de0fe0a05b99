"""Filters, projections, enrichment and row visibility (FLT-*, PRJ-*, JOI-1,
WIN-2). All are plain Catalyst expressions / joins: filters on scan
columns are pushed into the Parquet reader."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.schemas import DEFAULT_MIN_STOCK, LEGACY_NAMES, PERMISSIONS


# ---------------------------------------------------------------------------
# PRJ-1..4
# ---------------------------------------------------------------------------
def _rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    # One select with aliases: names that differ only in case (item_id /
    # Item_ID) must not be renamed twice, as sequential renames would.
    return df.select([F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def to_legacy(df: DataFrame) -> DataFrame:
    """Database column names -> legacy worksheet headers; others unchanged."""
    return _rename(df, LEGACY_NAMES)


def from_legacy(df: DataFrame) -> DataFrame:
    return _rename(df, {v: k for k, v in LEGACY_NAMES.items()})


def with_generated(df: DataFrame, table: str) -> DataFrame:
    """Generated columns, recomputed from their inputs."""
    if table == "inventory":
        return df.withColumn("profit_margin", (F.col("selling_price") - F.col("cost_price")).cast("decimal(10,2)"))
    if table == "sales_log":
        return df.withColumn("total_amount", (F.col("quantity_sold") * F.col("unit_price")).cast("decimal(12,2)"))
    if table == "restock_orders":
        return df.withColumn("total_cost", (F.col("quantity_ordered") * F.col("cost_per_unit")).cast("decimal(12,2)"))
    return df


def public_users(usr: DataFrame) -> DataFrame:
    """Users without secrets."""
    return usr.drop("password_hash")


def with_item_defaults(df: DataFrame, as_of: dt.date) -> DataFrame:
    """New-item defaults: description '', min level 5, SKU 'N/A', added and
    last restocked today."""
    today = F.lit(as_of)
    return (
        df.withColumn("description", F.coalesce(F.col("description"), F.lit("")))
        .withColumn("min_stock_level", F.coalesce(F.col("min_stock_level"), F.lit(DEFAULT_MIN_STOCK)))
        .withColumn("sku", F.coalesce(F.col("sku"), F.lit("N/A")))
        .withColumn("date_added", F.coalesce(F.col("date_added"), today))
        .withColumn("last_restocked", F.coalesce(F.col("last_restocked"), today))
    )


# ---------------------------------------------------------------------------
# JOI-1
# ---------------------------------------------------------------------------
def enrich_inventory(inv: DataFrame, sup: DataFrame) -> DataFrame:
    """Inventory with its supplier's name; 'Unknown' when there is none."""
    s = sup.select("supplier_id", F.col("supplier_name"))
    return inv.join(s, "supplier_id", "left").withColumn(
        "supplier_name", F.coalesce(F.col("supplier_name"), F.lit("Unknown"))
    )


# ---------------------------------------------------------------------------
# FLT-1 / FLT-2 search
# ---------------------------------------------------------------------------
SEARCH_COLUMNS = ["item_name", "item_code", "category", "supplier_name"]


def search_items(inv_enriched: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring match over name, code, category and
    supplier. '%' and '_' are literal; an empty query matches everything;
    NULL fields match nothing (the reference's str(None) would match 'none')."""
    q = F.lit(query.lower())
    hit = None
    for c in SEARCH_COLUMNS:
        h = F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q)
        hit = h if hit is None else hit | h
    return inv_enriched.where(hit)


def text_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def text_match(inv: DataFrame, terms: list[str], match_all: bool = True) -> DataFrame:
    """Token match over name + description (no stemming). ``match_all``: every
    term must occur (the '&' of a text query), else any term."""
    toks = text_tokens(F.concat_ws(" ", F.col("item_name"), F.coalesce(F.col("description"), F.lit(""))))
    conds = [F.array_contains(toks, t.lower()) for t in terms]
    if not conds:
        return inv
    cond = conds[0]
    for c in conds[1:]:
        cond = (cond & c) if match_all else (cond | c)
    return inv.where(cond)


# ---------------------------------------------------------------------------
# FLT-6 / FLT-7
# ---------------------------------------------------------------------------
def by_key(df: DataFrame, key: str, id_col: str, code_col: str) -> DataFrame:
    """Point lookup by UUID (36 characters) or else by code; decided on the
    driver from the key text, so the predicate is pushed to the scan."""
    col = id_col if len(key) == 36 else code_col
    return df.where(F.col(col).cast("string") == F.lit(key))


def between_dates(sales: DataFrame, start: dt.date, end: dt.date, col: str = "sale_date") -> DataFrame:
    """Inclusive date range (partition pruning when partitioned by date)."""
    return sales.where(F.col(col).between(F.lit(start), F.lit(end)))


# ---------------------------------------------------------------------------
# FLT-8 row visibility, FLT-9 action permission
# ---------------------------------------------------------------------------
# (table, role, scope) for SELECT: 'all' or 'own' (rows of the viewer).
SELECT_POLICY = [
    ("inventory", "Admin", "all"), ("inventory", "Staff", "all"),
    ("sales_log", "Admin", "all"), ("sales_log", "Staff", "all"),
    ("suppliers", "Admin", "all"), ("suppliers", "Staff", "all"),
    ("restock_orders", "Admin", "all"), ("restock_orders", "Staff", "all"),
    ("users", "Admin", "all"), ("users", "Staff", "own"),
    ("activity_log", "Admin", "all"), ("activity_log", "Staff", "own"),
]
# (table, action, role, scope) for writes; '*' is any role, even none. Admins may write all tables.
WRITE_POLICY = [
    ("inventory", "INSERT", "Staff", "all"), ("inventory", "UPDATE", "Staff", "all"),
    ("sales_log", "INSERT", "Staff", "all"),
    ("restock_orders", "INSERT", "Staff", "all"), ("restock_orders", "UPDATE", "Staff", "all"),
    ("users", "UPDATE", "Staff", "own"),
    ("activity_log", "INSERT", "*", "own"),
]
OWNER_COLUMN = {"users": "user_id", "activity_log": "user_id"}


def user_role(usr: DataFrame, uid) -> Column:
    """Role of one user as a scalar subquery (NULL for an unknown user)."""
    return usr.where(F.col("user_id") == F.lit(uid)).select(F.max("role")).scalar()


def visible_rows(df: DataFrame, table: str, usr: DataFrame, uid) -> DataFrame:
    """Rows of ``table`` that user ``uid`` may SELECT: Admin all; Staff all of
    inventory, sales, suppliers and orders but only their own row of users
    and own rows of activity_log; an unknown user nothing."""
    role = user_role(usr, uid)
    scopes = {r: s for t, r, s in SELECT_POLICY if t == table}
    cond = F.lit(False)
    for r, scope in scopes.items():
        ok = F.lit(True) if scope == "all" else (F.col(OWNER_COLUMN[table]) == F.lit(uid))
        cond = cond | ((role == r) & ok)
    return df.where(cond)


def write_allowed(requests: DataFrame, table: str, action: str, usr: DataFrame) -> DataFrame:
    """``requests`` (rows of ``table`` with the requesting user in ``by_user``)
    with ``allowed``: whether the user's role, or owning the row, permits
    ``action`` (INSERT, UPDATE or DELETE). Unknown users may only insert
    their own audit rows."""
    roles = usr.select(F.col("user_id").alias("_uid"), F.col("role").alias("_role"))
    ok = F.col("_role") == "Admin"
    for t, a, role, scope in WRITE_POLICY:
        if (t, a) == (table, action):
            mine = F.lit(True) if scope == "all" else F.col(OWNER_COLUMN[table]).eqNullSafe(F.col("by_user")) & F.col("by_user").isNotNull()
            ok = ok | (mine if role == "*" else mine & (F.col("_role") == role))
    joined = requests.join(roles, F.col("by_user") == F.col("_uid"), "left")
    return joined.withColumn("allowed", F.coalesce(ok, F.lit(False))).drop("_uid", "_role")


def visible_counts(df: DataFrame, table: str, usr: DataFrame) -> DataFrame:
    """For every user: how many rows of ``table`` they may see. 'all' is the
    table count (scalar), 'own' the per-owner count (one aggregate) - no
    user x row product is formed."""
    total = df.select(F.count(F.lit(1))).scalar()
    scopes = {r: s for t, r, s in SELECT_POLICY if t == table}
    u = usr.select("user_id", "role")
    if table in OWNER_COLUMN:
        own = df.groupBy(F.col(OWNER_COLUMN[table]).alias("user_id")).agg(F.count(F.lit(1)).alias("_own"))
        u = u.join(own, "user_id", "left")
    else:
        u = u.withColumn("_own", F.lit(0))
    n = F.lit(0).cast("bigint")
    for r, scope in reversed(list(scopes.items())):
        v = total if scope == "all" else F.coalesce(F.col("_own"), F.lit(0))
        n = F.when(F.col("role") == r, v).otherwise(n)
    return u.select("user_id", "role", n.cast("bigint").alias("visible_rows"))


def permission_table(spark: SparkSession) -> DataFrame:
    """(role, permission) pairs: a fixed handful of rows."""
    rows = [(r, p) for r, ps in PERMISSIONS.items() for p in ps]
    return spark.createDataFrame(rows, "role string, permission string")


def allowed(requests: DataFrame, usr: DataFrame, policy: DataFrame) -> DataFrame:
    """``requests`` (user_id, permission, ...) with ``allowed``: the user's
    role grants the permission. No role (unknown user) -> denied. The policy
    has a fixed handful of rows, so it is broadcast."""
    r = requests.join(usr.select("user_id", "role"), "user_id", "left")
    p = F.broadcast(policy.withColumn("_grant", F.lit(True)))
    return r.join(p, ["role", "permission"], "left").withColumn(
        "allowed", F.coalesce(F.col("_grant"), F.lit(False))
    ).drop("_grant")


# ---------------------------------------------------------------------------
# WIN-2 newest row per key
# ---------------------------------------------------------------------------
def dedup_latest(df: DataFrame, key: str, ts: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Keep the newest row per ``key`` (ties broken by ``tiebreak``, larger
    wins). An aggregate (max_by over a struct), not a window: partial
    aggregation runs map-side, so a key holding a third of the rows costs
    one partial row per task instead of one giant window partition."""
    order = F.struct(F.col(ts), *[F.col(c) for c in (tiebreak or [])])
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in others]), order).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns)
