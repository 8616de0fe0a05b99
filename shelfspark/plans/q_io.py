"""Source / sink round trips (SRC-1..3, SNK-1..3) over derived tables."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.plans.catalog import REGISTRY, register
from shelfspark.plans.oracle import RAW_SQL
from shelfspark.schemas import RAW_HEADERS, raw_schema
from shelfspark.session import scratch
from shelfspark.sources import adapter as A
from shelfspark.sources import appends as AP
from shelfspark.sources import io as IO
from shelfspark.sources import raw as W

_INV_COLS = [(h, "VARCHAR") for h in RAW_HEADERS["INVENTORY"]]


@register(
    "snapshot_roundtrip",
    _INV_COLS,
    "SELECT * FROM raw_inventory",
    extra_ctes=RAW_SQL,
    notes="SNK-1 export (CSV snapshot folders) -> SRC-3 newest snapshot -> SRC-1 header CSV read",
)
def q_snapshot_roundtrip(spark, d):
    root = scratch(spark, "snapshots")
    tables = {"INVENTORY": W.raw_inventory(spark, d), "SUPPLIERS": W.raw_suppliers(spark, d)}
    IO.export_snapshot(tables, root, dt.datetime(2026, 1, 1, 9, 0, 0))
    IO.export_snapshot({"INVENTORY": W.raw_inventory(spark, d)}, root, dt.datetime(2026, 1, 2, 9, 0, 0))
    latest = IO.latest_snapshot(spark, root)
    return IO.read_raw(spark, f"{latest}/INVENTORY", "INVENTORY")


@register(
    "append_activity",
    [("log_id", "BIGINT"), ("user_id", "VARCHAR"), ("action", "VARCHAR"), ("details", "VARCHAR")],
    """
SELECT e.log_id,
       CASE WHEN length(e.user_ref) = 36 THEN ui.uid WHEN starts_with(e.user_ref, 'USR') THEN uc.uid END AS user_id,
       e.action,
       CASE WHEN length(e.user_ref) = 36 AND ui.uid IS NULL THEN '[User: ' || e.user_ref || '] ' || e.details
            ELSE e.details END AS details
FROM (SELECT log_id, action, details,
             CASE WHEN action = 'RECORD_SALE' THEN 'WEB_SESSION'
                  WHEN action IN ('LOGIN', 'LOGIN_FAILED') THEN printf('USR%03d', user_id + 1)
                  ELSE printf('%08d-0000-4000-8000-%012d', log_id, user_id) END AS user_ref
      FROM activity_log) e
LEFT JOIN (SELECT user_code AS code, CAST(user_id AS VARCHAR) AS uid FROM users) uc ON e.user_ref = uc.code
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS uid FROM users) ui
  ON length(e.user_ref) = 36 AND e.user_ref = ui.uid""",
    notes="SNK-3: user refs resolved (code, id, or none); orphan ids keep a [User: x] note",
)
def q_append_activity(spark, d):
    return IO.append_activity(_audit_events(A.activity_log(spark, d)), A.users(spark, d))


def _audit_events(log):
    """Audit rows with the user as a code, an id or none, as the callers give it."""
    ref = (F.when(F.col("action") == "RECORD_SALE", F.lit("WEB_SESSION"))
           .when(F.col("action").isin("LOGIN", "LOGIN_FAILED"), F.format_string("USR%03d", F.col("user_id") + 1))
           .otherwise(F.format_string("%08d-0000-4000-8000-%012d", F.col("log_id"), F.col("user_id"))))
    return log.select("log_id", "action", "details", ref.alias("user_ref"))


@register(
    "aligned_sales",
    [(h, "VARCHAR") for h in RAW_HEADERS["SALES_LOG"]],
    """
SELECT Date, Time, Item_ID, Item_Name, Quantity_Sold, Unit_Price, Total_Amount, Payment_Method, Sold_By,
       '' AS Transaction_ID
FROM raw_sales""",
    extra_ctes=RAW_SQL,
    notes="SNK-2: rows aligned to the target headers (absent -> '', extra dropped)",
)
def q_aligned_sales(spark, d):
    s = W.raw_sales(spark, d).drop("Transaction_ID").withColumn("Cashier_Note", F.lit("x"))
    return IO.append_aligned(s, RAW_HEADERS["SALES_LOG"])


@register(
    "materialized_sales_range",
    [("transaction_code", "VARCHAR"), ("item_id", "BIGINT"), ("sale_date", "DATE"), ("quantity_sold", "INTEGER")],
    """
SELECT transaction_code, item_id, sale_date, quantity_sold FROM sales_log
WHERE sale_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'""",
    notes="SRC-2 typed scan of the month-partitioned model (partition pruning on sale_month)",
)
def q_materialized_sales_range(spark, d):
    root = scratch(spark, "model")
    paths = IO.materialize_model(spark, d, root)
    s = IO.read_table(spark, paths["sales_log"], "sales_log")
    s = s.where(F.col("sale_month").between("1997-01", "1997-03"))  # prunes month folders
    s = s.where(F.col("sale_date").between(dt.date(1997, 1, 1), dt.date(1997, 3, 31)))
    return s.select("transaction_code", "item_id", "sale_date", "quantity_sold")


def _derived_once(spark, d):
    """The raw sales stored, for jobs that write them several times, and the steps that hold them: their joins run once, not
    once a write, and leave no shuffle files behind."""
    steps = IO.Steps(spark, "raw-sales")
    return steps(W.raw_sales(spark, d), "sales"), steps


@register(
    "append_readback",
    [(h, "VARCHAR") for h in RAW_HEADERS["SALES_LOG"]],
    """
SELECT Date, Time, Item_ID, Item_Name, Quantity_Sold, Unit_Price, Total_Amount, Payment_Method, Sold_By, Transaction_ID
FROM raw_sales
UNION ALL SELECT Date, Time, Item_ID, 'say "' || Item_Name || '", ok', Quantity_Sold, Unit_Price, Total_Amount,
       Payment_Method, '', Transaction_ID FROM raw_sales""",
    extra_ctes=RAW_SQL,
    notes="SNK-2: two appends to one CSV folder, the second with quoted cells and without Sold_By, read back whole",
)
def q_append_readback(spark, d):
    path = scratch(spark, "sales-csv")
    (s, steps), headers = _derived_once(spark, d), RAW_HEADERS["SALES_LOG"]
    IO.append_csv(s, path, headers)
    quoted = F.concat(F.lit('say "'), F.col("Item_Name"), F.lit('", ok'))
    IO.append_csv(s.withColumn("Item_Name", quoted).drop("Sold_By"), path, headers)
    steps.drop("sales")
    return IO.read_raw(spark, path, "SALES_LOG")


@register(
    "append_twice_readback",
    [(h, "VARCHAR") for h in RAW_HEADERS["SALES_LOG"]],
    "SELECT * FROM raw_sales",
    extra_ctes=RAW_SQL,
    notes="SNK-2 under a batch id: every batch appended twice, one attempt left without its commit; each row counts once",
)
def q_append_twice(spark, d):
    log = AP.AppendLog(spark, scratch(spark, "sales-appends"), raw_schema("SALES_LOG"), "csv")
    s, _ = _derived_once(spark, d)
    for k in range(3):
        part = s.where(F.pmod(F.xxhash64("Transaction_ID"), F.lit(3)) == k)
        log.write_attempt(part, f"part-{k}")  # a job that was lost before its commit
        log.append(part, f"part-{k}")
        log.append(part, f"part-{k}")  # a job that was run again after it
    return log.read()


@register(
    "append_activity_stream",
    [("log_id", "BIGINT"), ("user_id", "VARCHAR"), ("action", "VARCHAR"), ("details", "VARCHAR")],
    REGISTRY["append_activity"].oracle_body,
    notes="SNK-3 as a stream that is run twice without its checkpoint: the batch number keeps the audit rows single",
)
def q_append_activity_stream(spark, d):
    events, root = A.read_stream(spark, d, "events"), scratch(spark, "audit-appends")
    log = AP.AppendLog(spark, root, T.StructType().add("log_id", "long").add("user_id", "string")
                       .add("action", "string").add("details", "string"))
    for attempt in range(2):
        AP.run_appends(A.activity_log(spark, d, events=events), log, "audit", f"{root}/checkpoint-{attempt}",
                       prepare=lambda df: IO.append_activity(_audit_events(df), A.users(spark, d)))
    return log.read()
