"""Exactly-once intake without a horizon: late repeats, late new rows, retries, hits only read their bucket."""

import os
import tempfile

from pyspark.sql import functions as F

from shelfspark.streaming.intake import KeyTable, first_rows, run_intake, take_new

SCHEMA = "code string, day date, n int"


def folder(name):
    return tempfile.mkdtemp(prefix=f"shelfspark-intake-{name}-")


def frame(spark, rows):
    return spark.createDataFrame(rows, "code string, day string, n int").withColumn("day", F.to_date("day"))


def taken(spark, out):
    rows = spark.read.schema(SCHEMA + ", batch_id int").parquet(out).collect()
    return sorted(((r.code, r.n, r.batch_id) for r in rows), key=str)


def test_stream_judges_rows_that_are_ten_years_late(spark):
    src, base = folder("src"), folder("out")
    batches = [[("a", "2021-01-01", 1), ("b", "2021-01-02", 2)],
               [("a", "2011-01-01", 9), ("c", "2011-01-01", 3), (None, "2011-01-01", 4)],  # a repeat and new rows, late
               [("c", "2031-01-01", 9), (None, "2001-01-01", 9), ("d", "2001-01-01", 5), ("d", "2001-01-02", 6)],
               [("a", "1991-01-01", 9)],
               []]
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{src}/x")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{src}/x")
        out = run_intake(stream, "late", key="code", order=["day"], buckets=4, fan=2, base=base)
        assert out.schema.names == ["code", "day", "n", "batch_id"]
    got = {(r.code, r.n, r.batch_id) for r in out.collect()}
    assert got == {("a", 1, 0), ("b", 2, 0), ("c", 3, 1), (None, 4, 1), ("d", 5, 2)} and out.count() == 5


def test_a_batch_that_runs_again_changes_nothing(spark):
    out, table = folder("data"), KeyTable(spark, folder("seen"), buckets=4, fan=2)
    batches = [[("a", "2021-01-01", 1), ("b", "2021-01-01", 1)], [("b", "2021-01-01", 2), ("c", "2021-01-01", 2)], [("d", "2021-01-01", 3)]]
    for k, rows in enumerate(batches):
        take_new(frame(spark, rows), k, table, out, "code", ["day"])
        before, live = taken(spark, out), table.live()
        take_new(frame(spark, rows), k, table, out, "code", ["day"])
        assert taken(spark, out) == before and table.live() == live
    assert before == [("a", 1, 0), ("b", 1, 0), ("c", 2, 1), ("d", 3, 2)]
    assert [level for level, _ in live] == [0, 1]  # 3 = 2 + 1


def test_matches_a_plain_set_on_many_keys_and_errs_rarely_in_the_filter(spark):
    out, table = folder("data"), KeyTable(spark, folder("seen"), buckets=8, fan=3)
    seen, want = set(), 0
    for k in range(5):
        keys = [f"k{(i * 7 + k * 1000) % 9000}" for i in range(2500)]
        take_new(frame(spark, [(c, "2021-01-01", k) for c in keys]), k, table, out, "code", ["day"])
        want += len(set(keys) - seen)
        seen |= set(keys)
        assert len(table.live()) <= 4
    rows = taken(spark, out)
    assert len(rows) == want == len(seen) and {r[0] for r in rows} == seen
    mine = table.hashed(spark.createDataFrame([(c,) for c in seen], "code string"), "code")
    assert table.suspects(mine).select("_key").distinct().count() == len(seen)  # the filter misses none
    others = table.hashed(spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("code")), "code")
    assert table.suspects(others).select("_key").distinct().count() < 20_000 * 0.03 * len(table.live())
    assert table.seen(others).count() == 0


def test_only_buckets_with_a_hit_are_read(spark):
    out, table = folder("data"), KeyTable(spark, folder("seen"), buckets=16)
    take_new(frame(spark, [(f"k{i}", "2021-01-01", 0) for i in range(400)]), 0, table, out, "code", ["day"])
    probe = table.hashed(spark.createDataFrame([("k7",)], "code string"), "code")
    bucket = probe.first()._bucket
    keys = os.path.join(table.root, table.live()[0][1], "keys")
    for f in os.listdir(keys):
        if f.startswith("_bucket=") and f != f"_bucket={bucket}":
            for part in os.listdir(os.path.join(keys, f)):
                open(os.path.join(keys, f, part), "wb").close()  # no Parquet any more: reading it would fail
    assert [r._key for r in table.seen(probe).collect()] == ["k7"]


def test_hot_key_ties_empty_and_odd_names(spark):
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "z"), ("x", 1, "a"), ("x", 1, "a"), (None, None, None), (None, 5, "q")],
                               "`a.b` string, n int, `we``ird` string")
    got = {tuple(r) for r in first_rows(df, "a.b", ["n"]).collect()}
    assert got == {("x", 1, "a"), (None, None, None)}
    out, table = folder("data"), KeyTable(spark, folder("seen"), buckets=4)
    take_new(df, 0, table, out, "a.b", ["n"])
    take_new(df.limit(0), 1, table, out, "a.b", ["n"])
    take_new(df, 2, table, out, "a.b", ["n"])
    assert spark.read.schema(df.schema).parquet(out).count() == 2
