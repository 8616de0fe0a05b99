"""Appends under a batch id: each batch counts once, whatever failed or was repeated."""

import os
import tempfile

import pytest
from pyspark.sql.types import StructType

from conftest import rows
from shelfspark.sources.appends import AppendLog, run_appends

SCHEMA = StructType().add("id", "long").add("note", "string")


def _root():
    return tempfile.mkdtemp(prefix="shelfspark-appends-")


def test_repeated_and_failed_appends(spark):
    log = AppendLog(spark, _root(), SCHEMA)
    assert log.read().count() == 0 and log.read().schema == SCHEMA
    one = spark.createDataFrame([(1, "a", 9), (1, "a", 9)], "id long, note string, extra int")
    assert log.append(one, "d1") and not log.append(one, "d1")
    log.write_attempt(one, "d2")  # lost before its commit: not part of the table
    assert rows(log.read()) == [(1, "a"), (1, "a")]
    assert log.append(spark.createDataFrame([(2,)], "id int"), "d2")
    assert log.append(one.limit(0), "d3")
    assert rows(log.read().where("id = 2")) == [(2, None)] and log.read().count() == 3


def test_first_attempt_wins(spark):
    log = AppendLog(spark, _root(), SCHEMA)
    a = log.write_attempt(spark.createDataFrame([(1, "a")], SCHEMA), "x")
    b = log.write_attempt(spark.createDataFrame([(2, "b")], SCHEMA), "x")
    assert log.commit("x", b) and not log.commit("x", a) and not log.commit("x", b)
    assert rows(log.read()) == [(2, "b")]
    assert os.listdir(f"{log.root}/data/x") == [b.split("/")[1]]
    assert [f for f in os.listdir(f"{log.root}/pending") if not f.startswith(".")] == []


def test_vacuum_keeps_what_counts_and_what_may_run(spark):
    log = AppendLog(spark, _root(), SCHEMA)
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    log.append(df, "x")
    log.write_attempt(df, "x")
    assert log.vacuum() == 0
    assert log.vacuum(older_than_s=-60) == 1 and log.read().count() == 1


def test_csv_cells(spark):
    log = AppendLog(spark, _root(), StructType().add("a", "string").add("b", "string").add("c", "string"), "csv")
    log.append(spark.createDataFrame([('say "x", ok', "two\nlines"), (" pad ", "")], "b string, a string"), "k.1")
    log.append(spark.createDataFrame([(None, 5)], "a string, c int"), "k.2")
    assert rows(log.read()) == [("", "", "5"), ("", " pad ", ""), ("two\nlines", 'say "x", ok', "")]


def test_bad_batch_names(spark):
    log = AppendLog(spark, _root(), SCHEMA)
    for name in ("", "../x", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            log.append(spark.createDataFrame([(1, "a")], SCHEMA), name)


def test_stream_run_again_without_its_checkpoint(spark):
    src, root = _root(), _root()
    for k in range(3):
        spark.createDataFrame([(k, "n")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{src}/x")
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/x")
    log = AppendLog(spark, root, SCHEMA)
    for attempt in range(2):
        out = run_appends(feed, log, "s", f"{root}/checkpoint-{attempt}")
        assert sorted(r.id for r in out.collect()) == [0, 1, 2]
