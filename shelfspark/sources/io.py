"""Sources and sinks (SRC-1..3, SNK-1..3) and model materialisation.

Snapshots are folders ``<root>/snapshot_ts=<yyyyMMdd_HHmmss>/<TABLE>/``
of header CSV (the reference's worksheet exports). Typed tables are
Parquet. Paths may be any Hadoop-compatible URI (HDFS, S3, ABFS);
listing uses the Hadoop FileSystem API and touches metadata only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.schemas import RAW_HEADERS, TYPED, raw_schema
from shelfspark.session import scratch

SNAPSHOT_PREFIX = "snapshot_ts="
# Empty cells stay empty strings (not NULL), as a CSV DictReader sees them.
_NULL_TOKEN = "\u0000"
# Quotes inside a cell are doubled and blanks kept, as any CSV reader expects.
CSV_QUOTES = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

CSV_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


class Steps:
    """Stored steps of one job: what a long job holds on disk is then the shuffles of one step and the tables it
    reads and writes, not all shuffles to its end.

    Calling it writes a frame as Parquet under the shared checkpoint folder and reads it back. The shuffle files behind it
    are no longer needed; a collection on the driver lets Spark's cleaner drop them. ``only``: the steps to store, others pass as they are."""

    def __init__(self, spark: SparkSession, name: str, only: tuple[str, ...] | None = None):
        self.spark, self.root, self.only = spark, scratch(spark, name), only

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        if self.only is not None and name not in self.only:
            return df
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a step's table once nothing reads it."""
        fs, path = _fs(self.spark, f"{self.root}/{name}")
        fs.delete(path, True)


def _csv_reader(spark: SparkSession):
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("nullValue", _NULL_TOKEN).option("emptyValue", "").options(**CSV_QUOTES).option("multiLine", True))


# SRC-1
def read_raw(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Header CSV, every field text; columns are the file's header. A missing
    file gives an empty table (with the known headers of ``table``)."""
    try:
        df = _csv_reader(spark).csv(path)
        return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
            raise
        schema = raw_schema(table) if table in RAW_HEADERS else T.StructType([])
        return spark.createDataFrame([], schema)


# SRC-2
def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Typed table scan: the table's columns with their typed types, plus
    any partition columns of the folder layout (e.g. sale_month). Column
    pruning, pushed filters and partition pruning happen in the reader."""
    df = spark.read.parquet(path)
    typed = TYPED[table]
    have = {f.name: f.dataType for f in df.schema.fields}
    # Cast only where the stored type differs, so filters stay pushable.
    cols = [F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in typed.fields if f.name in have]
    extra = [c for c in df.columns if c not in typed.fieldNames()]
    return df.select(*cols, *extra)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm  # noqa: SLF001 - Hadoop FileSystem for listing only
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


# SRC-3
def latest_snapshot(spark: SparkSession, root: str) -> str | None:
    """Newest snapshot folder under ``root`` by its timestamp name (object
    stores have no reliable modification time); None when there is none."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    snaps = sorted(n for n in names if n.startswith(SNAPSHOT_PREFIX))
    return f"{root.rstrip('/')}/{snaps[-1]}" if snaps else None


def snapshot_name(ts: dt.datetime) -> str:
    return SNAPSHOT_PREFIX + ts.strftime("%Y%m%d_%H%M%S")


# SNK-1
def export_snapshot(tables: dict[str, DataFrame], root: str, ts: dt.datetime) -> str:
    """Write each non-empty table as header CSV under a new snapshot folder;
    empty tables are skipped. Returns the snapshot path."""
    base = f"{root.rstrip('/')}/{snapshot_name(ts)}"
    for name, df in tables.items():
        if df.isEmpty():
            continue
        (df.write.mode("overwrite").option("header", True).option("nullValue", "")
         .option("emptyValue", "").options(**CSV_QUOTES).csv(f"{base}/{name}"))
    return base


# SNK-2
def append_aligned(df: DataFrame, target_columns: list[str]) -> DataFrame:
    """Rows aligned to the target's headers: target order, absent fields ''
    and extra fields dropped (write the result with mode('append'))."""
    have = set(df.columns)
    return df.select([(F.col(c).cast("string") if c in have else F.lit("")).alias(c) for c in target_columns])


def append_csv(df: DataFrame, path: str, target_columns: list[str]) -> None:
    """Append rows, aligned to the target's headers, to a folder of header CSV
    (read back with `read_raw`). Part files are committed with the job, so a
    failed append leaves nothing behind. They are gzipped: repeated texts would take
    several times the room, and a file whose cells may hold line ends is read by one task either way."""
    (append_aligned(df, target_columns).write.mode("append").option("header", True).option("nullValue", _NULL_TOKEN)
     .option("emptyValue", "").options(**CSV_QUOTES).options(**CSV_GZIP).csv(path))


# SNK-3
def append_activity(events: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows to append. ``events``: user_ref, action, details.
    A 36-character ref is a user id; a 'USR...' ref is looked up by user
    code (unknown -> NULL user); other refs (e.g. 'WEB_SESSION') -> NULL.
    An id that names no user would violate the foreign key: the row is kept
    with a NULL user and '[User: <ref>] ' before its details."""
    ref = F.col("user_ref")
    by_code = users.select(F.col("user_code").alias("_code"), F.col("user_id").cast("string").alias("_uid_c"))
    by_id = users.select(F.col("user_id").cast("string").alias("_uid_i"))
    is_id = F.length(ref) == 36
    j = (events.join(by_code, ref == F.col("_code"), "left")
         .join(by_id, is_id & (ref == F.col("_uid_i")), "left"))
    orphan = is_id & F.col("_uid_i").isNull()
    uid = F.when(is_id, F.col("_uid_i")).when(ref.startswith("USR"), F.col("_uid_c"))
    return j.select(
        *[c for c in events.columns if c not in ("user_ref", "details")],
        uid.alias("user_id"),
        "action",
        F.when(orphan, F.concat(F.lit("[User: "), ref, F.lit("] "), F.col("details"))).otherwise(F.col("details"))
        .alias("details"),
    )


def materialize_model(spark: SparkSession, sf_dir: str, out_root: str, mode: str = "overwrite") -> dict[str, str]:
    """Write the six model tables once as Parquet so reports scan them
    instead of re-deriving them: sales partitioned by sale month (date
    filters prune partitions), orders by order month; others plain."""
    from shelfspark.sources import adapter as A

    model = A.load_model(spark, sf_dir)
    paths = {}
    for name, df in model.items():
        path = f"{out_root.rstrip('/')}/{name}"
        w = df
        # Range partitioning on (month, item) splits a hot month over many
        # tasks, while each task still writes few month folders.
        if name == "sales_log":
            w = df.withColumn("sale_month", F.date_format("sale_date", "yyyy-MM"))
            w = w.repartitionByRange("sale_month", "item_id")
            w.write.mode(mode).partitionBy("sale_month").parquet(path)
        elif name == "restock_orders":
            w = df.withColumn("order_month", F.date_format("date_ordered", "yyyy-MM"))
            w = w.repartitionByRange("order_month", "item_id")
            w.write.mode(mode).partitionBy("order_month").parquet(path)
        else:
            w.write.mode(mode).parquet(path)
        paths[name] = path
    return paths
