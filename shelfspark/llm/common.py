"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import checkpoint_dir

# ASCII white space of the word rules (fixed values): space, tab .. carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table with the columns asked for."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def text_of(column: str | Column = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def id_text(column: str = "doc_id") -> Column:
    """An integer id as text, for the way through pandas, which turns longs beside a null into doubles."""
    return F.col(column).cast("long").cast("string").alias(column)


def with_long_id(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """The id as a long again."""
    return df.withColumn(column, F.col(column).cast("long"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


_NOTED: list[list[str]] = []


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Add the folders of the tables written meanwhile to ``paths``."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.pop()


def release(paths: list[str], docs: DataFrame) -> None:
    """Remove noted tables that ``docs`` doesn't read."""
    spark, files = docs.sparkSession, docs.inputFiles()
    for path in paths:
        if not any(path.rsplit("/", 1)[1] in f for f in files):
            _delete(spark, path)
    paths.clear()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, in a compressed columnar form that
    every executor can read again after one is lost. The folder is removed
    when the driver's JVM ends. The shuffle files behind the table are no
    longer needed; a collection on the driver lets Spark's cleaner drop them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    for paths in _NOTED:
        paths.append(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no later step reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def partitions_for(spark: SparkSession) -> int:
    """The session's shuffle width: what AQE may coalesce, never fewer than the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def per_process() -> dict:
    """A dict that lives as long as the Python worker process.

    Functions travel to the workers by value, so their module globals are new
    in every task; what is costly to load is kept here between tasks.
    """
    import sys

    return sys.__dict__.setdefault("_shelfspark_llm", {})
