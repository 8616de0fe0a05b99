"""Sales of any period from one roll-up (REP-3..5 and AGG-3 without going back to the sales).

Sums of days add up to weeks, months and ranges; distinct transactions and items don't, as a key may be
sold on many days. `sales_rollup` therefore notes for each key and day the key's *next* day, and counts
keys by (day, next day). A period counts each of its keys once, on the key's last day within it: where
the next day is outside or there is none. So exact distinct counts of every range come from a table of at
most one row per pair of days (a few million for ten years), whatever the number of keys.
Bitmaps by day and bucket would do the same, but take 4 KB for each day and bucket with a single key:
with transaction ids in no order of time that is 4 KB a sale.

Plan: the sales are read once; one shuffle by key carries, after map-side combine, a row per key and
task with its days (one for each calendar day at most, so a hot key is a small row); the second
shuffle carries a row per pair of days and task. The roll-up is meant to be written (`write_rollup`).

Missing days form a period of their own in each grain, as in `reports.sales_summary`, and belong to no range; missing
keys count for the sums only; an empty table gives an empty roll-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.money import avg_money_from, cents, round_ratio
from shelfspark.operators.reports import SUM_T

NO_DAY = -(1 << 31)  # a missing day among the days of a key: sorts first
SUMS = ["units", "revenue", "revenue_cents", "priced"]
COLUMNS = ["sale_date", "next_date", "transactions", "items", *SUMS]


def _date(days: Column) -> Column:
    return F.when(days != NO_DAY, F.date_from_unix_date(days))


def sales_rollup(sales: DataFrame) -> DataFrame:
    """Per (sale_date, next_date): the transactions and items sold on the one and next on the other (none:
    null); the day's sums stand where next_date is null."""
    day = F.coalesce(F.unix_date("sale_date"), F.lit(NO_DAY))
    own = [F.col("quantity_sold").cast("long").alias("units"), F.col("total_amount").cast(SUM_T).alias("revenue"),
           cents("total_amount").alias("revenue_cents"), F.col("total_amount").isNotNull().cast("long").alias("priced")]
    whole = all(isinstance(sales.schema[c].dataType, T.IntegralType) for c in ("transaction_id", "item_id"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("long" if whole else "string").alias("key"))
                      for kind, key in [("day", day), ("txn", F.col("transaction_id")), ("item", F.col("item_id"))]])
    rows = sales.select(day.alias("day"), *own, F.explode(kinds).alias("k")).select("day", *SUMS, "k.kind", "k.key").where("key IS NOT NULL")
    per_day = F.col("kind") == "day"
    keys = rows.groupBy("kind", "key").agg(
        F.sort_array(F.collect_set("day")).alias("days"), *[F.sum(F.when(per_day, F.col(c))).alias(c) for c in SUMS])
    steps = F.transform("days", lambda d, i: F.struct(d.alias("day"), F.get("days", i + 1).alias("next")))
    return (keys.select("kind", *SUMS, F.explode(steps).alias("s")).groupBy("s.day", "s.next")
            .agg(F.count_if(F.col("kind") == "txn").alias("transactions"), F.count_if(F.col("kind") == "item").alias("items"),
                 F.sum("units").alias("units"), F.sum("revenue").cast(SUM_T).alias("revenue"),
                 F.sum("revenue_cents").cast("decimal(38,0)").alias("revenue_cents"), F.sum("priced").alias("priced"))
            .select(_date(F.col("day")).alias("sale_date"), _date(F.col("next")).alias("next_date"), *COLUMNS[2:]))


def write_rollup(sales: DataFrame, path: str) -> DataFrame:
    """The roll-up as a table, to be read by any number of reports."""
    sales_rollup(sales).write.mode("overwrite").parquet(path)
    return sales.sparkSession.read.parquet(path)


def _totals(last: Column) -> list[Column]:
    """Aggregates over the rows of one period; ``last``: the row's keys have no later day in it."""
    def counted(c: str) -> Column:
        return F.coalesce(F.sum(F.when(last, F.col(c))), F.lit(0)).cast("bigint").alias(f"_{c}")

    return [counted("transactions"), F.sum("units").cast("bigint").alias("total_items_sold"),
            F.sum("revenue").cast(SUM_T).alias("total_revenue"), counted("items"),
            F.sum("revenue_cents").cast("decimal(38,0)").alias("_cents"), F.sum("priced").alias("_priced")]


def _period_start(grain: str, day: str) -> Column:
    return F.col(day) if grain == "day" else F.date_trunc(grain, F.col(day)).cast("date")


def summary(rollup: DataFrame, grain: str = "day") -> DataFrame:
    """`reports.sales_summary` from the roll-up: the rows of a day, week or month."""
    name = {"day": "sale_date", "week": "week_start", "month": "month_start"}[grain]
    start = _period_start(grain, "sale_date")
    last = F.col("next_date").isNull() | ~start.eqNullSafe(_period_start(grain, "next_date"))
    rows = rollup.select(start.alias(name), last.alias("_last"), *COLUMNS[2:])
    label = [F.date_format(name, "yyyy-MM").alias("month_label")] if grain == "month" else []
    return rows.groupBy(name).agg(*_totals(F.col("_last"))).select(
        name, *label, F.col("_transactions").alias("total_transactions"), "total_items_sold", "total_revenue",
        avg_money_from(F.col("_cents"), F.col("_priced")).alias("avg_transaction_value"),
        F.col("_items").alias("unique_items_sold")).orderBy(F.desc(name))


def range_summaries(rollup: DataFrame, ranges: DataFrame) -> DataFrame:
    """`reports.sales_range_summary` for many ranges at once, with distinct items too. ``ranges``: range_start and
    range_end (inclusive); one row per different range, also where nothing was sold, or it ends before it
    starts, or lacks an end (counts 0, sums null). Ranges meet the roll-up day by day, by an equal join."""
    r = ranges.select("range_start", "range_end").distinct()
    days = F.when(F.col("range_start") <= F.col("range_end"), F.sequence("range_start", "range_end"))
    r = r.select("*", F.explode_outer(days).alias("sale_date"))
    last = F.col("next_date").isNull() | (F.col("next_date") > F.col("range_end"))
    micro = round_ratio(F.col("_cents") * 10000, F.col("_priced"))
    return r.join(rollup, "sale_date", "left").groupBy("range_start", "range_end").agg(*_totals(last)).select(
        "range_start", "range_end", F.col("_transactions").alias("total_transactions"), "total_items_sold", "total_revenue",
        (micro.cast("decimal(38,0)") / F.lit(1000000)).cast("decimal(18,6)").alias("avg_transaction_value"),
        F.col("_items").alias("unique_items_sold"))
