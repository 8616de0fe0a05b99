"""Skew-safe ordered running totals (segmented prefix sums).

`Window.partitionBy(key).orderBy(...)` puts every row of a key into one
task; with a key holding a third of the table that task holds a third of
the data. Instead:

1. range-partition on (key, order) and sort within partitions - Spark's
   sampled range bounds split a hot key over many partitions;
2. checkpoint to the shared checkpoint folder, so both passes below see
   the same partition contents (and lineage is cut);
3. per partition, an Arrow/pandas pass computes local running totals
   (O(1) state: the current key and its carry);
4. per (partition, key) totals are prefix-summed across partitions per
   key. Only the first key of a partition can continue from earlier
   partitions, so the offsets table has at most one row per partition:
   a proven bound, hence broadcast.

Values must be non-negative integers (quantities, counts).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.session import checkpoint_dir

PID = "_pid"
RID = "_rid"


_FLOOR = np.iinfo("int64").min


def _local_running(keys: list[str], value: str, out: str, op: str = "sum"):
    def fn(batches):
        carry_key = None
        carry = 0 if op == "sum" else _FLOOR
        for pdf in batches:
            if pdf.empty:
                pdf[out] = pd.Series([], dtype="int64")
                yield pdf
                continue
            v = pdf[value].fillna(0 if op == "sum" else _FLOOR).to_numpy(dtype="int64")
            kd = pdf[keys].astype(object).where(pdf[keys].notna(), "\0null")
            first = tuple(kd.iloc[0])
            changed = (kd != kd.shift()).any(axis=1).to_numpy()
            changed[0] = first != carry_key
            grp = np.cumsum(changed)
            g = pd.Series(v).groupby(grp)
            cs = (g.cumsum() if op == "sum" else g.cummax()).to_numpy(dtype="int64")
            if not changed[0]:
                head = grp == grp[0]
                cs[head] = cs[head] + carry if op == "sum" else np.maximum(cs[head], carry)
            carry_key = tuple(kd.iloc[-1])
            carry = int(cs[-1])
            pdf[out] = cs
            yield pdf

    return fn


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared checkpoint folder) computed once: the
    input is cached while the checkpoint job writes it, then released.
    Keeps the partitioning and in-partition order of ``df``."""
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def range_sorted(df: DataFrame, sort_cols: list[str], partitions: int | None = None,
                 row_id: bool = False) -> DataFrame:
    """Range-partitioned, sorted within partitions, checkpointed; adds the
    partition id (and optionally a stable row id)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    # The range bounds are sampled from the input and the checkpoint write
    # re-reads its input, so both are cached for the duration (spilling to
    # local disk; a lost cache block is recomputed from lineage).
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    # Without an explicit count the number of ranges follows
    # spark.sql.shuffle.partitions and AQE may coalesce adjacent ranges to
    # its advisory size - still contiguous ranges, so the passes stay exact.
    ranged = src.repartitionByRange(partitions, *sort_cols) if partitions else src.repartitionByRange(*sort_cols)
    parts = (
        ranged
        .sortWithinPartitions(*sort_cols)
        .withColumn(PID, F.spark_partition_id())
    )
    if row_id:
        parts = parts.withColumn(RID, F.monotonically_increasing_id())
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    out = parts.checkpoint(eager=True)
    parts.unpersist()
    src.unpersist()
    return out


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                  partitions: int | None = None, row_id: bool = False,
                  presorted: bool = False, op: str = "sum") -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``order``.

    ``presorted``: ``df`` is already the output of `range_sorted` on
    keys + order (carries ``_pid``); skips the repartition.
    Output keeps all input columns plus ``out`` (long) and ``_pid``.
    """
    parts = df if presorted else range_sorted(df, keys + order, partitions, row_id)
    schema = T.StructType(parts.schema.fields + [T.StructField(out, T.LongType(), True)])
    local = parts.mapInPandas(_local_running(keys, value, out, op), schema)
    w = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    if op == "sum":
        tot = parts.groupBy(PID, *keys).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_tot"))
        offs = tot.withColumn("_off", F.sum("_tot").over(w)).where(F.col("_off").isNotNull() & (F.col("_off") != 0))
    else:
        tot = parts.groupBy(PID, *keys).agg(F.max(F.col(value)).alias("_tot"))
        offs = tot.withColumn("_off", F.max("_tot").over(w)).where(F.col("_off").isNotNull())
    offs = offs.select(PID, *keys, "_off")
    # <= one row per partition (the partition's first key): bounded broadcast.
    j = local.join(F.broadcast(offs), [PID, *keys], "left")
    if op == "sum":
        return j.withColumn(out, F.col(out) + F.coalesce(F.col("_off"), F.lit(0))).drop("_off")
    best = F.greatest(F.col(out), F.coalesce(F.col("_off"), F.lit(_FLOOR)))
    return j.withColumn(out, F.when(best == F.lit(_FLOOR), F.lit(None)).otherwise(best)).drop("_off")


def _local_previous(keys: list[str], col: str, out: str):
    def fn(batches):
        carry_key = None
        carry = pd.NA
        first_seen = False
        for pdf in batches:
            if pdf.empty:
                pdf[out] = pd.Series([], dtype="Int64")
                pdf["_first"] = pd.Series([], dtype="bool")
                yield pdf
                continue
            kd = pdf[keys].astype(object).where(pdf[keys].notna(), "\0null")
            v = pdf[col].astype("Int64")  # nullable int64: exact for any long
            same = ~(kd != kd.shift()).any(axis=1).to_numpy()
            same[0] = carry_key is not None and tuple(kd.iloc[0]) == carry_key
            prev = v.shift()
            prev.iloc[0] = carry if same[0] else pd.NA
            prev[~same] = pd.NA
            first = np.zeros(len(pdf), dtype=bool)
            if not first_seen:
                first[0] = True
                first_seen = True
            pdf[out] = prev.to_numpy()
            pdf[out] = pdf[out].astype("Int64")
            pdf["_first"] = first
            carry_key = tuple(kd.iloc[-1])
            carry = v.iloc[-1]
            yield pdf

    return fn


def with_previous(parts: DataFrame, keys: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """On `range_sorted` output: ``out`` = ``col`` of the previous row of the
    same key (NULL for a key's first row). ``col`` is a long. Rows that
    start a partition take it from the previous partition's last row,
    through a table of at most one row per partition (broadcast)."""
    schema = T.StructType(parts.schema.fields + [T.StructField(out, T.LongType(), True),
                                                 T.StructField("_first", T.BooleanType(), False)])
    local = parts.mapInPandas(_local_previous(keys, col, out), schema)
    sort_struct = F.struct(*[F.col(c) for c in keys + order])
    last = parts.groupBy(PID).agg(F.max_by(F.struct(*[F.col(k).alias(f"_lk{i}") for i, k in enumerate(keys)],
                                                    F.col(col).alias("_lv")), sort_struct).alias("_last"))
    # The next partition that has rows (one row per partition in this window).
    bound = last.select(F.lead(PID).over(Window.orderBy(PID)).alias(PID), "_last.*").where(F.col(PID).isNotNull())
    j = local.join(F.broadcast(bound), PID, "left")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_lk{i}"))
    fixed = F.when(F.col("_first") & same, F.col("_lv")).otherwise(F.col(out))
    return j.withColumn(out, fixed).drop("_first", "_lv", *[f"_lk{i}" for i in range(len(keys))])
