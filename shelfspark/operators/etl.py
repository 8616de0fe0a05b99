"""Ingest of raw legacy snapshots into the typed model (ETL-1..6, JOI-7/8).

Each loader is one select over the raw frame plus key lookups (joins on
dimension-sized key tables, left to Spark's size-checked broadcast / AQE).
The reference inserts one row per request and prints failures; here every
row ends in exactly one of two frames: typed rows, or rejects with a
reason (what the database would have refused, or what the script skipped).

Keys of loaded rows are their business codes (unique by rule DQ-5), so a
reload is deterministic; the reference's UUIDs carry no information.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.clean import clean_date, clean_int, clean_money, code_number, format_code
from shelfspark.functions.scan import running_total
from shelfspark.schemas import ACCOUNT_STATUSES, CATEGORIES, ORDER_STATUSES, PAYMENT_METHODS, ROLES

AUTO_SUPPLIER_NOTE = "Auto-created from Inventory migration"


def _cell(df: DataFrame, name: str, default: str | None = None) -> Column:
    """Raw cell; when the column is absent, the reference's default."""
    if name in df.columns:
        return F.col(name)
    return F.lit(default).cast("string")


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _no_key(rows: DataFrame) -> Column:
    """A text that is no key, from a hash of the whole row: rows without a key spread over all partitions of a join."""
    return F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string"))


def _codes_complete(raw: DataFrame, col: str) -> bool:
    """Every raw row carries a code: then no numbering is needed. A scan of
    one column (pruned), instead of checking the loaded frame."""
    if col not in raw.columns:
        return False
    return raw.where(~_present(F.col(col))).select(col).isEmpty()


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with NULL reason, rows with a reason)."""
    tagged = df.withColumn("reject_reason", reason)
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.where(F.col("reject_reason").isNotNull())
    return good, bad


def _load_seq(raw: DataFrame, code: str) -> Column:
    """Load sequence as sortable text: an explicit ``_row`` column, else the
    code's number (so ITM2000 comes after ITM999), then the code."""
    if "_row" in raw.columns:
        return F.lpad(F.col("_row").cast("string"), 20, "0")
    if code not in raw.columns:
        return F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    return F.concat(F.lpad(F.regexp_extract(code, "([0-9]+)[^0-9]*$", 1), 20, "0"), F.col(code))


def _nth_of_code(rows: DataFrame, code: str, order: list[str], counts: Column) -> DataFrame:
    """``rows`` with ``_nth``, a row's place in ``order`` among the counting rows of its non-blank ``code``; every
    other row is the first of a key of its own, so that they spread over the partitions."""
    alone = F.when(counts & _present(F.col(code)), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy(code, "_alone").orderBy(*order, *rows.columns))
    return rows.withColumn("_alone", alone).withColumn("_nth", nth).drop("_alone")


def _first_of_code(rows: DataFrame, code: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, repeats): of the rows that share a non-blank ``code`` the first in ``order`` stays, as a unique key would
    have it. The rows are read and shuffled once. For those that stay Spark keeps a row per code and task before the
    shuffle (a limit per group), so a code that many rows share is no hot group; the repeats come from a sort of
    its rows, which spills."""
    numbered = _nth_of_code(rows, code, order, F.lit(True))
    return numbered.where("_nth = 1").drop("_nth"), numbered.where("_nth > 1").drop("_nth")


# ---------------------------------------------------------------------------
# ETL-4 sequential codes
# ---------------------------------------------------------------------------
def assign_codes(
    rows: DataFrame,
    code_col: str,
    existing_codes: DataFrame,
    prefix: str,
    order: list[str],
    day: Column | None = None,
    complete: bool | None = None,
) -> DataFrame:
    """Fill blank ``code_col`` with prefix + (max numeric suffix + n), n the
    row's position among rows lacking a code in ``order``; 3-digit pad, never
    truncated. With ``day`` the code is prefix + yyyyMMdd + '-' + number,
    numbered per day. Non-numeric suffixes of existing codes are skipped.

    Numbering is a skew-safe running count (range partitioned, no
    single-partition window), so one hot day or a global sequence is fine."""
    if complete:
        return rows
    need = rows.where(~_present(F.col(code_col)))
    have = rows.where(_present(F.col(code_col)))
    if complete is None and need.isEmpty():
        return rows
    if day is None:
        base = existing_codes.select(F.max(code_number(F.col(code_col), prefix)).alias("_m"))
        need = need.withColumn("_key", F.lit(0)).withColumn("_one", F.lit(1))
        numbered = running_total(need, ["_key"], order, "_one", "_n")
        top = F.coalesce(base.scalar(), F.lit(0))
        filled = numbered.withColumn(code_col, format_code(prefix, top + F.col("_n")))
    else:
        tag = F.date_format(day, "yyyyMMdd")
        need = need.withColumn("_key", tag).withColumn("_one", F.lit(1))
        ex = existing_codes.where(F.col(code_col).startswith(prefix)).select(
            F.substring(F.col(code_col), len(prefix) + 1, 8).alias("_key"),
            F.substring_index(F.col(code_col), "-", -1).try_cast("long").alias("_num"),
        )
        tops = ex.groupBy("_key").agg(F.max("_num").alias("_top"))
        numbered = running_total(need, ["_key"], order, "_one", "_n").join(tops, "_key", "left")
        filled = numbered.withColumn(
            code_col,
            F.format_string(prefix + "%s-%03d", F.col("_key"), F.coalesce(F.col("_top"), F.lit(0)) + F.col("_n")),
        )
    return have.unionByName(filled.select(*rows.columns))


# ---------------------------------------------------------------------------
# JOI-7 key lookup with fallback
# ---------------------------------------------------------------------------
def key_table(dim: DataFrame, id_col: str, key_cols: list[str], seq: str) -> DataFrame:
    """(key, id) for every non-blank value of ``key_cols``; a key that
    several rows share maps to the last row in ``seq`` order (later
    duplicates of a name overwrite earlier ones, as the reference's dict)."""
    texts = F.explode(F.array(*[F.col(k) for k in key_cols])).alias("_k")
    parts = dim.select(texts, F.col(id_col).alias("_id"), F.col(seq).alias("_seq")).where(_present(F.col("_k")))
    return parts.groupBy("_k").agg(F.max_by("_id", "_seq").alias("_id"))


def resolve_keys(raw: DataFrame, keys: DataFrame, lookups: list[str], out: str) -> DataFrame:
    """Add ``out`` = id of the first of ``lookups`` (raw columns, in order)
    whose text is a key of ``keys``; NULL when none is.

    A row asks under its first cell that has text, in one left join for all. Only rows whose text was no key and that have
    another cell ask again; the others pass by, so a fallback shuffles the rows that need it and no more. Rows that ask
    nothing go under a text that no key is, from a hash of the whole row, and spread over the partitions."""
    nothing, cells = _no_key(raw), [F.col(f"`{c}`") for c in raw.columns]
    asks = [F.when(_present(F.col(c)), F.col(c)) for c in lookups]
    left, done = raw, []
    for i in range(len(lookups)):
        # The i-th cell that has text; the rows of a later round have one.
        ask = F.coalesce(*asks, nothing) if i == 0 else F.coalesce(F.get(F.array_compact(F.array(*asks)), F.lit(i)), nothing)
        k = keys.select(F.col("_k").alias("_lk"), F.col("_id").alias("_id0"))
        found = left.join(k, ask == F.col("_lk"), "left").select(*cells, "_id0")
        if i + 1 == len(lookups):
            done.append(found)
            break
        # One value of both sides: as a plain condition its half on the raw cells would be pushed below the shuffle, and
        # the two branches could not read the same one.
        again = F.greatest((F.col("_id0").isNull() & (F.size(F.array_compact(F.array(*asks))) > i + 1)).cast("int"), F.lit(0))
        done.append(found.where(again == 0))
        left = found.where(again == 1).select(*cells)
    return reduce(DataFrame.unionByName, done).withColumnRenamed("_id0", out)


# ---------------------------------------------------------------------------
# ETL-3 loaders
# ---------------------------------------------------------------------------
REASON_DUPLICATE = "duplicate code"


def _coded(typed: DataFrame, bad: DataFrame, raw: DataFrame, code: str, raw_code: str, prefix: str,
           existing: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Repeated codes go to the rejects; blank codes continue after the
    highest code of the target table (``existing``) and of the batch."""
    if raw_code in raw.columns:
        typed, repeats = _first_of_code(typed, code, ["_seq"])
        again = repeats.select(F.col(code).alias(raw_code), F.lit(REASON_DUPLICATE).alias("reject_reason"))
        bad = bad.unionByName(again, allowMissingColumns=True)
    known = typed.select(code) if existing is None else existing.select(code).unionByName(typed.select(code))
    return assign_codes(typed, code, known, prefix, ["_seq"], complete=_codes_complete(raw, raw_code)), bad


def _split_first(df: DataFrame, reason: Column, code: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """As `_split`, and of the good rows the first of each code in the raw columns' ``order``; the others are rejected
    whole."""
    if code not in df.columns:
        return _split(df, reason)
    order = [c for c in order if c in df.columns]
    good, _ = _split(df, reason)
    fine = F.col("reject_reason").isNull()
    told = _nth_of_code(df.withColumn("reject_reason", reason), code, order, fine)
    bad = told.where(~fine | (F.col("_nth") > 1)).drop("_nth")
    return _first_of_code(good, code, order)[0], bad.withColumn("reject_reason", F.coalesce("reject_reason", F.lit(REASON_DUPLICATE)))


def load_suppliers(raw: DataFrame, existing: DataFrame | None = None, seq: str = "Supplier_ID") -> tuple[DataFrame, DataFrame]:
    name = _cell(raw, "Supplier_Name")
    df = raw.withColumn("_seq", _load_seq(raw, seq))
    good, bad = _split(df, F.when(~_present(name), F.lit("missing supplier name")))
    typed = good.select(
        F.coalesce(F.when(_present(_cell(good, "Supplier_ID")), _cell(good, "Supplier_ID")), F.lit("")).alias("supplier_code"),
        _cell(good, "Supplier_Name").alias("supplier_name"),
        F.coalesce(_cell(good, "Contact_Person", ""), F.lit("")).alias("contact_person"),
        F.coalesce(_cell(good, "Phone", ""), F.lit("")).alias("phone"),
        F.coalesce(_cell(good, "Email", ""), F.lit("")).alias("email"),
        F.coalesce(_cell(good, "Address", ""), F.lit("")).alias("address"),
        F.coalesce(_cell(good, "Payment_Terms", ""), F.lit("")).alias("payment_terms"),
        F.coalesce(_cell(good, "Notes", ""), F.lit("")).alias("notes"),
        "_seq",
    )
    typed, bad = _coded(typed, bad, raw, "supplier_code", "Supplier_ID", "SUP", existing)
    return typed.withColumn("supplier_id", F.col("supplier_code")), bad


def load_inventory(raw: DataFrame, suppliers: DataFrame, as_of: dt.date, seq: str = "Item_ID",
                   existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed inventory; supplier looked up by name only (NULL when unknown);
    defaults apply when a column is absent, not when a cell is blank."""
    sup_keys = key_table(suppliers, "supplier_id", ["supplier_code", "supplier_name"], "_seq")
    df = raw.withColumn("_seq", _load_seq(raw, seq))
    df = resolve_keys(df, sup_keys, ["Supplier_Name"], "_res_supplier") if "Supplier_Name" in raw.columns \
        else df.withColumn("_res_supplier", F.lit(None).cast("string"))
    cat = _cell(df, "Category", "Other")
    qty = clean_int(_cell(df, "Quantity_In_Stock", "0"))
    mn = clean_int(_cell(df, "Min_Stock_Level", "5"))
    cost = clean_money(_cell(df, "Cost_Price", "0"))
    sell = clean_money(_cell(df, "Selling_Price", "0"))
    reason = (
        F.when(~_present(_cell(df, "Item_Name")), "missing item name")
        .when(~cat.isin(*CATEGORIES), "invalid category")
        .when(qty < 0, "negative stock")
        .when((cost < 0) | (sell < 0), "negative price")
    )
    good, bad = _split(df, reason)
    typed = good.select(
        F.coalesce(F.when(_present(_cell(good, "Item_ID")), _cell(good, "Item_ID")), F.lit("")).alias("item_code"),
        cat.alias("category"),
        _cell(good, "Item_Name").alias("item_name"),
        F.coalesce(_cell(good, "Description", ""), F.lit("")).alias("description"),
        F.coalesce(_cell(good, "SKU", ""), F.lit("")).alias("sku"),
        qty.alias("quantity_in_stock"),
        mn.alias("min_stock_level"),
        cost.alias("cost_price"),
        sell.alias("selling_price"),
        (sell - cost).cast("decimal(10,2)").alias("profit_margin"),
        F.col("_res_supplier").alias("supplier_id"),
        F.coalesce(clean_date(_cell(good, "Date_Added", "")), F.lit(as_of)).alias("date_added"),
        clean_date(_cell(good, "Last_Restocked", "")).alias("last_restocked"),
        "_seq",
    )
    typed, bad = _coded(typed, bad, raw, "item_code", "Item_ID", "ITM", existing)
    return typed.withColumn("item_id", F.col("item_code")), bad


def load_users(raw: DataFrame, seq: str = "User_ID", existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    df = raw.withColumn("_seq", _load_seq(raw, seq))
    role = _cell(df, "Role", "Staff")
    status = _cell(df, "Account_Status", "Active")
    reason = (
        F.when(~_present(_cell(df, "Username")), "missing username")
        .when(~role.isin(*ROLES), "invalid role")
        .when(~status.isin(*ACCOUNT_STATUSES), "invalid account status")
    )
    good, bad = _split(df, reason)
    typed = good.select(
        F.coalesce(F.when(_present(_cell(good, "User_ID")), _cell(good, "User_ID")), F.lit("")).alias("user_code"),
        _cell(good, "Username").alias("username"),
        F.coalesce(_cell(good, "Email", ""), F.lit("")).alias("email"),
        F.coalesce(_cell(good, "Password_Hash", "pending_migration"), F.lit("")).alias("password_hash"),
        role.alias("role"),
        status.alias("account_status"),
        F.try_to_timestamp(F.when(_present(_cell(good, "Last_Login", "")), _cell(good, "Last_Login", "")))
        .cast("timestamp_ntz").alias("last_login"),
        F.coalesce(_cell(good, "Notes", ""), F.lit("")).alias("notes"),
        "_seq",
    )
    typed, bad = _coded(typed, bad, raw, "user_code", "User_ID", "USR", existing)
    return typed.withColumn("user_id", F.col("user_code")), bad


Step = Callable[[DataFrame, str], DataFrame]  # stores a frame between two shuffles of a loader (`io.Steps`)


def _at_once(df: DataFrame, name: str) -> DataFrame:
    return df


def load_sales(raw: DataFrame, inventory: DataFrame, users: DataFrame, as_of: dt.date, existing: DataFrame | None = None,
               order: list[str] | None = None, step: Step = _at_once) -> tuple[DataFrame, DataFrame]:
    """Item by old code, else by name (later duplicate names win); seller by
    user code or username, else NULL. Sales without an item are rejected;
    so are rows the typed table would refuse (quantity <= 0, negative
    price, payment method or time that the column does not accept, a code
    that an earlier row has; ``order`` is the load sequence, by default the
    cells' own order). ``step`` may store the rows with their "items", and of the good ones the "firsts" of each code."""
    item_keys = key_table(inventory, "item_id", ["item_code", "item_name"], "_seq")
    user_keys = key_table(users, "user_id", ["user_code", "username"], "_seq")
    complete = _codes_complete(raw, "Transaction_ID")
    df = step(resolve_keys(raw, item_keys, ["Item_ID", "Item_Name"], "_res_item"), "items")
    qty = clean_int(_cell(df, "Quantity_Sold", "0"))
    price = clean_money(_cell(df, "Unit_Price", "0"))
    pay = _cell(df, "Payment_Method", "Cash")
    tm = _cell(df, "Time", "00:00:00")
    reason = (
        F.when(F.col("_res_item").isNull(), "item not found")
        .when(qty <= 0, "invalid quantity")
        .when(price < 0, "negative price")
        .when(~pay.isin(*PAYMENT_METHODS), "invalid payment method")
        .when(~tm.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), "invalid time")
    )
    good, bad = _split_first(df, reason, "Transaction_ID", order or ["Date", "Time", "Item_ID", "Item_Name", "Quantity_Sold", "Unit_Price"])
    typed = good.select(
        F.coalesce(F.when(_present(_cell(good, "Transaction_ID")), _cell(good, "Transaction_ID")), F.lit("")).alias(
            "transaction_code"
        ),
        F.coalesce(clean_date(_cell(good, "Date", "")), F.lit(as_of)).alias("sale_date"),
        tm.alias("sale_time"),
        F.col("_res_item").alias("item_id"),
        qty.alias("quantity_sold"),
        price.alias("unit_price"),
        (qty * price).cast("decimal(12,2)").alias("total_amount"),
        pay.alias("payment_method"),
        _cell(good, "Sold_By").alias("_seller"),
    )
    # The sellers last, when the rows are few and narrow.
    typed = resolve_keys(step(typed, "firsts"), user_keys, ["_seller"], "sold_by").drop("_seller")
    known = typed if existing is None else existing.select("transaction_code").unionByName(typed.select("transaction_code"))
    typed = assign_codes(
        typed, "transaction_code", known.select("transaction_code"), "TXN",
        ["sale_date", "sale_time", "item_id"], day=F.lit(as_of), complete=complete,
    )
    return typed, bad


def load_orders(raw: DataFrame, suppliers: DataFrame, inventory: DataFrame, as_of: dt.date, existing: DataFrame | None = None,
                order: list[str] | None = None, step: Step = _at_once) -> tuple[DataFrame, DataFrame]:
    """Supplier by name only, item by code else name; orders missing either
    are skipped. Received iff date_received is set (else refused). ``step`` may store the rows with their "suppliers" and their "items"."""
    sup_keys = key_table(suppliers, "supplier_id", ["supplier_code", "supplier_name"], "_seq")
    item_keys = key_table(inventory, "item_id", ["item_code", "item_name"], "_seq")
    complete = _codes_complete(raw, "Order_ID")
    df = step(resolve_keys(raw, sup_keys, ["Supplier_Name"], "_res_supplier"), "suppliers")
    df = step(resolve_keys(df, item_keys, ["Item_ID", "Item_Name"], "_res_item"), "items")
    qty = clean_int(_cell(df, "Quantity_Ordered", "0"))
    cost = clean_money(_cell(df, "Cost_Per_Unit", "0"))
    status = _cell(df, "Status", "Pending")
    received = clean_date(_cell(df, "Date_Received", ""))
    reason = (
        F.when(F.col("_res_supplier").isNull() | F.col("_res_item").isNull(), "missing supplier or item")
        .when(qty <= 0, "invalid quantity")
        .when(cost < 0, "negative cost")
        .when(~status.isin(*ORDER_STATUSES), "invalid status")
        .when((status == "Received") != received.isNotNull(), "received date does not match status")
    )
    good, bad = _split_first(df, reason, "Order_ID", order or ["Date_Ordered", "Item_ID", "Quantity_Ordered"])
    typed = good.select(
        F.coalesce(F.when(_present(_cell(good, "Order_ID")), _cell(good, "Order_ID")), F.lit("")).alias("order_code"),
        F.coalesce(clean_date(_cell(good, "Date_Ordered", "")), F.lit(as_of)).alias("date_ordered"),
        F.col("_res_supplier").alias("supplier_id"),
        F.col("_res_item").alias("item_id"),
        qty.alias("quantity_ordered"),
        cost.alias("cost_per_unit"),
        (qty * cost).cast("decimal(12,2)").alias("total_cost"),
        clean_date(_cell(good, "Expected_Delivery", "")).alias("expected_delivery"),
        status.alias("status"),
        received.alias("date_received"),
    )
    known = typed if existing is None else existing.select("order_code").unionByName(typed.select("order_code"))
    typed = assign_codes(
        typed, "order_code", known.select("order_code"), "PO",
        ["date_ordered", "item_id"], day=F.lit(as_of), complete=complete,
    )
    return typed, bad


# ---------------------------------------------------------------------------
# ETL-5 supplier repair (JOI-8 anti join inside)
# ---------------------------------------------------------------------------
def repair_suppliers(raw_inv: DataFrame, suppliers: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Create a supplier for every name used in the raw inventory but
    missing from ``suppliers`` (note "Auto-created from Inventory
    migration", next SUP codes), then link each item (by code) to the
    supplier named in its raw row. Returns (suppliers, inventory)."""
    used = raw_inv.where(_present(F.col("Supplier_Name"))).select(F.col("Supplier_Name").alias("supplier_name"))
    missing = used.distinct().join(suppliers.select("supplier_name"), "supplier_name", "left_anti")
    new = missing.select(
        F.lit("").alias("supplier_code"),
        "supplier_name",
        *[F.lit("").alias(c) for c in ["contact_person", "phone", "email", "address", "payment_terms"]],
        F.lit(AUTO_SUPPLIER_NOTE).alias("notes"),
        F.col("supplier_name").alias("_seq"),
    )
    new = assign_codes(new, "supplier_code", suppliers.select("supplier_code"), "SUP", ["_seq"])
    new = new.withColumn("supplier_id", F.col("supplier_code"))
    cols = ["supplier_id", "supplier_code", "supplier_name", "contact_person", "phone", "email", "address",
            "payment_terms", "notes"]
    all_sup = suppliers.select(*[F.col(c).cast("string") for c in cols]).unionByName(new.select(*cols))
    by_name = all_sup.groupBy("supplier_name").agg(F.min("supplier_id").alias("_sid"))
    links = (
        raw_inv.where(_present(F.col("Supplier_Name")) & _present(F.col("Item_ID")))
        .select(F.col("Item_ID").alias("item_code"), F.col("Supplier_Name").alias("supplier_name"))
        .join(by_name, "supplier_name", "inner")
        .groupBy("item_code").agg(F.max("_sid").alias("_sid"))
    )
    inv = inventory.join(links, "item_code", "left").withColumn(
        "supplier_id", F.coalesce(F.col("_sid"), F.col("supplier_id").cast("string"))
    ).drop("_sid")
    return all_sup, inv


# ---------------------------------------------------------------------------
# ETL-6 username conflicts (case-insensitive)
# ---------------------------------------------------------------------------
def username_conflicts(new: DataFrame, users: DataFrame) -> DataFrame:
    """New usernames that collide, ignoring case, with an existing user or
    with another new row. One row per offending new username."""
    n = new.select("username", F.lower("username").alias("_lk"))
    existing = users.select(F.lower("username").alias("_lk")).distinct().withColumn("_existing", F.lit(True))
    dup = n.groupBy("_lk").agg(F.count(F.lit(1)).alias("_n"))
    return (
        n.join(existing, "_lk", "left")
        .join(dup, "_lk", "left")
        .where(F.col("_existing").eqNullSafe(True) | (F.col("_n") > 1))
        .select(
            "username",
            F.when(F.col("_existing").eqNullSafe(True), "exists").otherwise("duplicate in batch").alias("conflict"),
        )
    )
