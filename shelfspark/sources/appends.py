"""Appends that count once however often they are done (SNK-2, SNK-3).

A plain append writes its rows again when a job is run again after its commit. Here every append
carries a batch id (a day, a file name, a stream's batch number). Its rows go to a folder
of their own, and a commit file named after the batch then tells which folder counts:

    <root>/data/<batch>/<attempt>/part-*      rows of one attempt
    <root>/commits/<batch>.json               {"batch": ..., "folder": "<batch>/<attempt>"}

The commit file is written aside and renamed without overwriting, so it is there as a whole or not at
all, and the first of several attempts wins (on HDFS and ABFS also between jobs that run at the same time; on a
store without an exclusive rename one job at a time must write). Readers read the folders that
commits name: an attempt that failed, is still running, or came second is never seen. A batch that has
its commit is not computed again.

Rows are aligned to the table's columns: its order, missing fields null in Parquet, others dropped. CSV text has
no nulls: missing fields and missing values are read as '', as by `io.read_raw`.
An empty batch is committed too; a table without commits is empty. What the driver holds is one line per batch.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.sources.io import CSV_GZIP, CSV_QUOTES, _NULL_TOKEN, append_aligned
from shelfspark.streaming.core import finish

_BATCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class AppendLog:
    """A table under ``root`` with fixed columns, stored as 'parquet' or as header 'csv' (all columns text)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, fmt: str = "parquet"):
        if fmt not in ("parquet", "csv"):
            raise ValueError(f"unknown format {fmt!r}")
        self.spark, self.root, self.schema, self.fmt = spark, root.rstrip("/"), schema, fmt

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path("data").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit_path(self, batch: str):
        if not _BATCH.fullmatch(batch):
            raise ValueError(f"batch id {batch!r} is no file name")
        return self._path("commits", f"{batch}.json")

    def is_committed(self, batch: str) -> bool:
        return self._files().exists(self._commit_path(batch))

    def write_attempt(self, df: DataFrame, batch: str) -> str:
        """Rows of one attempt, not yet part of the table; the folder's name."""
        self._commit_path(batch)
        folder = f"{batch}/{uuid.uuid4().hex}"
        if self.fmt == "csv":
            w = append_aligned(df, self.schema.names).write.options(**CSV_QUOTES).options(**CSV_GZIP)
            w.option("header", True).option("nullValue", _NULL_TOKEN).option("emptyValue", "").csv(f"{self.root}/data/{folder}")
        else:
            have = set(df.columns)
            cols = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
            df.select(cols).write.parquet(f"{self.root}/data/{folder}")
        return folder

    def commit(self, batch: str, folder: str) -> bool:
        """Make an attempt the batch's rows; False, and the attempt is removed, where another one was first."""
        jvm, target = self.spark._jvm, self._commit_path(batch)
        files = self._files()
        files.mkdirs(self._path("commits"))
        aside = self._path("pending", f"{uuid.uuid4().hex}.json")
        out = files.create(aside, True)
        out.write(bytearray(json.dumps({"batch": batch, "folder": folder}).encode() + b"\n"))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(aside), files.makeQualified(target), keep)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            files.delete(aside, False)
            if folder != self._folder(batch):  # committing the same attempt again is no second one
                files.delete(self._path("data", *folder.split("/")), True)
            return False

    def append(self, df: DataFrame, batch: str) -> bool:
        """Rows of a batch; False, without computing them, where it is in the table already."""
        if self.is_committed(batch):
            return False
        return self.commit(batch, self.write_attempt(df, batch))

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("batch string, folder string").json(f"{self.root}/commits")

    def _folder(self, batch: str) -> str:
        return self.spark.read.schema("folder string").json(self._commit_path(batch).toString()).first().folder

    def folders(self) -> list[str]:
        """Folders that count, in the order of batch ids."""
        if not self._files().exists(self._path("commits")):
            return []
        return [r.folder for r in self._commits().orderBy("batch").collect()]  # one per batch

    def read(self) -> DataFrame:
        """The table: rows of every committed batch once."""
        paths = [f"{self.root}/data/{f}" for f in self.folders()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        if self.fmt == "parquet":
            return self.spark.read.schema(self.schema).parquet(*paths)
        r = self.spark.read.schema(self.schema).option("header", True).option("enforceSchema", False)
        r = r.option("nullValue", _NULL_TOKEN).option("emptyValue", "").options(**CSV_QUOTES).option("multiLine", True)
        return r.csv(paths).select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in self.schema.names])

    def vacuum(self, older_than_s: int = 7 * 86400) -> int:
        """Remove attempts that no commit names and that are older than any running job; how many."""
        named, removed, files = set(self.folders()), 0, self._files()
        limit = (time.time() - older_than_s) * 1000
        if not files.exists(self._path("data")):
            return 0
        for batch in files.listStatus(self._path("data")):
            for attempt in files.listStatus(batch.getPath()):
                name = f"{batch.getPath().getName()}/{attempt.getPath().getName()}"
                if name not in named and attempt.getModificationTime() <= limit:
                    files.delete(attempt.getPath(), True)
                    removed += 1
        return removed


def run_appends(stream: DataFrame, log: AppendLog, name: str, checkpoint: str, timeout_s: int = 1800,
                prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A stream appended micro-batch by micro-batch, to its end; the table. ``foreachBatch`` may call
    a batch again after a failure or restart: it is then in the table already."""
    def write_batch(df: DataFrame, epoch_id: int) -> None:
        log.append(prepare(df), f"{name}-{epoch_id:012d}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    finish(writer.foreachBatch(write_batch).start(), name, timeout_s)
    return log.read()
