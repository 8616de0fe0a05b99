"""Running a Structured Streaming plan to completion over a file source.

`run_to_table` starts the stream with ``availableNow`` (all data present at
start, then stop), writes the sink as Parquet into a fresh folder under the
session's shared checkpoint folder (with the stream's own checkpoint next
to it, so a restart resumes exactly), and returns a batch read of the
result. Nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shelfspark.session import remove, scratch, state_width


def _join(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *parts])


def finish(q: StreamingQuery, name: str, timeout_s: int) -> None:
    """Wait for a query that ends by itself; its failure, or that it didn't end, is raised."""
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_to_table(stream: DataFrame, name: str, output_mode: str = "append", timeout_s: int = 1800,
                 base: str | None = None) -> DataFrame:
    spark = stream.sparkSession
    root = base or scratch(spark, f"stream-{name}")
    out, ckpt = _join(root, "data"), _join(root, "checkpoint")
    writer = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if output_mode == "append":
        with state_width(spark, keyed=True):
            q = writer.format("parquet").outputMode("append").start(out)
    else:
        # Update / complete modes through foreachBatch, which may call a batch
        # again after a failure: each batch has its own folder, overwritten by
        # a retry (update), or replaces the result (complete).
        def write_batch(df, epoch_id):
            df.write.mode("overwrite").parquet(out if output_mode == "complete" else f"{out}/batch_id={epoch_id}")

        with state_width(spark, keyed=True):
            q = writer.outputMode(output_mode).foreachBatch(write_batch).start()
    finish(q, name, timeout_s)
    try:
        return spark.read.schema(stream.schema).parquet(out)
    except AnalysisException:  # the stream emitted no row: no file was written
        return spark.createDataFrame([], stream.schema)


def run_revisions(stream: DataFrame, name: str, timeout_s: int = 1800, base: str | None = None) -> DataFrame:
    """The rows of every micro-batch with its ``batch_id``; a retried batch overwrites its own folder."""
    return run_partials(stream, name, lambda df: df, timeout_s, base, numbered=True)


def run_partials(stream: DataFrame, name: str, partial: Callable[[DataFrame], DataFrame], timeout_s: int = 1800,
                 base: str | None = None, numbered: bool = False) -> DataFrame:
    """Partial aggregates of every micro-batch as one table, for a final merge.

    No event is ever late and no window waits for a watermark: a batch of any
    order adds its partial rows, and the merge of all partial rows is the
    view as of now. A batch that is retried overwrites its own folder. Each batch lets Spark's cleaner drop the shuffle files of the one
    before; a run that no later one can go on from (no ``base``) leaves its rows only, not its checkpoint."""
    spark = stream.sparkSession
    root = base or scratch(spark, f"stream-{name}")
    out, ckpt = _join(root, "data"), _join(root, "checkpoint")

    def write_batch(df: DataFrame, epoch_id: int) -> None:
        partial(df).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch_id={epoch_id}")
        spark._jvm.System.gc()

    with state_width(spark):
        q = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(write_batch).start()
    finish(q, name, timeout_s)
    if base is None:
        remove(spark, ckpt)
    rows = spark.read.parquet(out)
    return rows if numbered else rows.drop("batch_id")
