"""Session configuration shared by the library, tests and bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime SQL settings every operator relies on. They can be changed on a
# live session, so `configure` also works on a cluster session handed to us.
RUNTIME_CONF = {
    # Dates and "as of" arithmetic must not depend on the host clock zone.
    "spark.sql.session.timeZone": "UTC",
    # Bad casts raise; operators use try_cast where the reference tolerates junk.
    "spark.sql.ansi.enabled": "true",
    # Runtime re-planning: coalesce small shuffles, split skewed join keys,
    # switch to broadcast when a side turns out small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Rows handed to a Python worker at once: bounds its memory where rows hold whole texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Let AQE coalesce / re-plan plans that are cached (the ordered scans
    # cache their range-partitioned input while checkpointing it).
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
}


def ship_code() -> None:
    """Make the library's functions travel by value to Python workers.

    The pandas functions run in executor-side Python processes, which need
    not have this package installed or on their path (e.g. when the entry
    file is loaded from elsewhere, or on a cluster). Pickling the package's
    functions by value ships their code with each task, with no files to
    distribute."""
    from pyspark import cloudpickle

    import shelfspark

    cloudpickle.register_pickle_by_value(shelfspark)


# Shuffles of the retail queries: how many partitions they start with, and how much of a shuffle AQE leaves in one.
WIDTH, ADVISED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
WIDTH_BYTES = 8 << 20  # of the tables' files for each partition: some 450,000 line items
ADVISED_BYTES = 16 << 20
RETAIL_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def shuffle_width(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = RETAIL_TABLES) -> int:
    """Shuffle partitions for the tables: in proportion to their files, so that a task's share, and the memory of its sorts
    and hash maps, is the same at any size; never fewer than the session's."""
    size = 0
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            size += files.getContentSummary(path).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // WIDTH_BYTES))


def configure(spark: SparkSession, sf_dir: str | None = None) -> SparkSession:
    """The library's settings; with ``sf_dir`` the shuffles are as wide as its tables ask for."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if sf_dir is None:
        spark.conf.unset(WIDTH)
        spark.conf.unset(ADVISED)
    else:
        spark.conf.set(WIDTH, str(shuffle_width(spark, sf_dir)))
        spark.conf.set(ADVISED, str(ADVISED_BYTES))
    ship_code()
    return spark


# State of a row per key outgrows the heap with the keys: RocksDB keeps it on disk, and all stores of an executor share a bound of memory.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "512",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def state_width(spark: SparkSession, keyed: bool = False) -> Iterator[None]:
    """Streams started meanwhile deal their state to as many partitions as the session's wide shuffles have: AQE leaves
    stateful steps alone, and they keep the number that their checkpoint began with. ``keyed``: state of a row per key, in RocksDB."""
    key = "spark.sql.shuffle.partitions"
    mine = {key: str(max(int(spark.conf.get(key)), int(spark.conf.get(WIDTH, None) or 0))), **(ROCKS if keyed else {})}
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def build_session(
    master: str | None = None,
    app: str = "shelfspark",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local or cluster session with the library's settings.

    On a cluster leave ``master`` as None so spark-submit decides, and size
    ``shuffle_partitions`` to the data (about 128-256 MB per partition).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder for cutting lineage.

    A cluster names it in ``spark.checkpoint.dir``; we use that. Only a
    local-mode session (tests, bench) without the setting gets a private
    scratch folder. A cluster session without the setting is an error:
    a machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server side owns the setting
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS)") from None
        return current
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS)")
    path = tempfile.mkdtemp(prefix="shelfspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder for one run's own
    tables; it is removed when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop_path)
    files.deleteOnExit(hadoop_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this run wrote and nothing reads any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
