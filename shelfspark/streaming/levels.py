"""Partial tables in levels: a feed's aggregates without rereading all of its batches.

Every micro-batch adds one table to level 0. When a level has ``fan`` tables they are merged
into one of the next level, so after n batches at most (fan - 1) * log(n) tables are live and each
row has been rewritten at most log(n) times. A manifest per batch names the live tables.
It is written last: a batch that fails before it leaves the manifest before in force, and a
batch that runs again starts from that one, overwrites its own tables and
comes to the same state. Tables that neither this manifest nor the one before names are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shelfspark.session import scratch
from shelfspark.streaming.core import _join, finish


class Levels:
    """The live tables under ``root``; ``merge`` turns rows of several tables into fewer of the same columns."""

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], fan: int = 4):
        self.spark, self.root, self.merge, self.fan = spark, root, merge, fan

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(_join(self.root, *parts))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        """Batches with a manifest, in order."""
        folder = self._path("manifest")
        if not self._files().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files().listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and self._files().exists(self._path("manifest", n, "_SUCCESS")))

    def live(self, before: int | None = None) -> list[tuple[int, str]]:
        """(level, table) of the newest manifest, or of the newest one older than a batch."""
        batches = [b for b in self._batches() if before is None or b < before]
        if not batches:
            return []
        rows = self.spark.read.schema("level int, name string").json(_join(self.root, "manifest", str(batches[-1])))
        return sorted((r.level, r.name) for r in rows.collect())  # (fan - 1) * log(batches) at most

    def add(self, partial: DataFrame, batch: int) -> None:
        """One batch's rows; a repeated batch changes nothing."""
        before = self.live(before=batch)
        tables = [*before, (0, self._write(partial, 0, batch))]
        level = 0
        while sum(at == level for at, _ in tables) >= self.fan:
            full = [name for at, name in tables if at == level]
            merged = self.merge(self._read(full, partial.schema))
            tables = [t for t in tables if t[0] != level] + [(level + 1, self._write(merged, level + 1, batch))]
            level += 1
        rows = self.spark.createDataFrame(tables, "level int, name string").coalesce(1)
        rows.write.mode("overwrite").json(_join(self.root, "manifest", str(batch)))
        named = {name for _, name in [*before, *tables]}
        for f in self._files().listStatus(self._path()):
            name = f.getPath().getName()
            if name.startswith("level") and name not in named:
                self._files().delete(f.getPath(), True)

    def _write(self, df: DataFrame, level: int, batch: int) -> str:
        name = f"level{level}-{batch}"
        df.write.mode("overwrite").parquet(_join(self.root, name))
        return name

    def _read(self, names: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[_join(self.root, n) for n in names])

    def read(self, schema: StructType) -> DataFrame:
        """All rows of the live tables."""
        names = [name for _, name in self.live()]
        return self._read(names, schema) if names else self.spark.createDataFrame([], schema)


def run_levels(stream: DataFrame, name: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame],
               fan: int = 4, timeout_s: int = 1800, base: str | None = None) -> DataFrame:
    """Partial aggregates of every micro-batch, kept in levels; the rows of the live tables at the end."""
    root = base or scratch(stream.sparkSession, f"stream-{name}")
    levels = Levels(stream.sparkSession, _join(root, "data"), merge, fan)
    schema = []

    def write_batch(df: DataFrame, epoch_id: int) -> None:
        rows = partial(df)
        schema[:] = [rows.schema]
        levels.add(rows, epoch_id)

    writer = stream.writeStream.option("checkpointLocation", _join(root, "checkpoint")).trigger(availableNow=True)
    finish(writer.foreachBatch(write_batch).start(), name, timeout_s)
    # Without a new batch in this run, the tables tell their own columns.
    names = [n for _, n in levels.live()]
    kind = schema[0] if schema else stream.sparkSession.read.parquet(_join(root, "data", names[0])).schema
    return levels.read(kind)
