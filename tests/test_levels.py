"""Partial tables in levels: few live tables, retried batches, a run that resumes."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfspark.streaming.levels import Levels, run_levels


def merge(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def total(levels, schema):
    return {r.k: r.n for r in merge(levels.read(schema)).collect()}


def test_few_tables_are_live_and_a_retry_changes_nothing(spark):
    levels = Levels(spark, tempfile.mkdtemp(prefix="shelfspark-levels-"), merge, fan=2)
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long").coalesce(1)
    for batch in range(11):
        levels.add(frame, batch)
        if batch == 7:  # all batches so far are one table; the batch runs again, as after a failure
            assert [level for level, _ in levels.live()] == [3]
            levels.add(frame, batch)
    assert [level for level, _ in levels.live()] == [0, 1, 3]  # 11 = 8 + 2 + 1
    assert total(levels, frame.schema) == {"a": 11, "b": 22}
    folders = [f for f in os.listdir(levels.root) if f.startswith("level")]
    assert len(folders) <= 6  # the live tables, and those of the manifest before


def test_a_batch_that_fails_before_its_manifest_leaves_the_state(spark):
    calls = []

    def failing(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return merge(df)

    levels = Levels(spark, tempfile.mkdtemp(prefix="shelfspark-levels-"), failing, fan=2)
    frame = spark.createDataFrame([("a", 1)], "k string, n long").coalesce(1)
    levels.add(frame, 0)
    with pytest.raises(RuntimeError):
        levels.add(frame, 1)
    assert levels.live() == [(0, "level0-0")] and total(levels, frame.schema) == {"a": 1}
    levels.add(frame, 1)
    assert levels.live() == [(1, "level1-1")] and total(levels, frame.schema) == {"a": 2}


def test_stream_resumes_on_its_levels(spark):
    src, base = tempfile.mkdtemp(prefix="shelfspark-levels-src-"), tempfile.mkdtemp(prefix="shelfspark-levels-out-")
    schema = "k string, n long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "x"))
        return {r.k: r.n for r in merge(run_levels(stream, "levels", merge, merge, fan=2, base=base)).collect()}

    for k in range(3):
        spark.createDataFrame([("a", k + 1)], schema).coalesce(1).write.mode("append").parquet(os.path.join(src, "x"))
    assert run() == {"a": 6}
    assert run() == {"a": 6}  # nothing new
    spark.createDataFrame([("a", 10), ("c", 1)], schema).coalesce(1).write.mode("append").parquet(os.path.join(src, "x"))
    assert run() == {"a": 16, "c": 1}
