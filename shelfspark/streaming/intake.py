"""ST-5 without a horizon: every key counts once, however late its repeat comes.

`operators.dedup_stream` forgets a key once the watermark passes it, and drops rows behind the watermark
unread. Here the keys seen are a table instead of stream state, so no row is ever too late and the stream
itself holds nothing. Keys are dealt to ``buckets`` by hash, and each stored table has two parts:

    <table>/keys/bucket=<b>/     the keys
    <table>/filter/bucket=<b>/   a Bloom filter per bucket, one row per 64-bit word that is not empty

A key has one word of its bucket's filter (word size: ``KEYS_A_WORD`` keys on average) and sets ``MARKS`` bits
there, so a key is tested by one join on (bucket, word) with a batch's keys. A micro-batch then goes in these steps:

1. one row per key of the batch: the first by the given order, ties by the other columns (map-side
   minimum, so a key with a third of the rows sends one row per task);
2. test of these keys against the filters of the buckets they fall in;
3. only buckets with a hit are read, and decide exactly (the filter alone errs on about 1 in 100 new keys);
4. new rows are written under the batch's number, their keys become a table of level 0.

Tables are merged in `levels.Levels`, so a batch meets logarithmically many of them, and
a batch that runs again is judged by the manifest before it. The driver holds bucket numbers only (``buckets`` at most).

A null key is a key like any other. Repeated rows and ties keep one row; an empty batch adds
nothing. Columns may have any name beside ``_key``, ``_bucket``, ``_hash``, ``_place``, and any type that Spark can order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from shelfspark.session import scratch
from shelfspark.streaming.core import _join, finish
from shelfspark.streaming.levels import Levels

BUCKETS = 64
KEYS_A_WORD = 4
MARKS = 4
_FILTER = "_bucket int, _place long, bits long"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _marks() -> Column:
    """The bits that a key sets in its word: six bits of a second hash for each."""
    second = F.xxhash64("_hash")
    at = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(MARKS)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), a) for a in at]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


class KeyTable(Levels):
    """The keys seen so far; rows are (_key, _hash, _bucket)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan: int = 4):
        # A key is added once, so tables share none and a merge only lays them out anew.
        super().__init__(spark, root, lambda df: df.repartition("_bucket", "_hash"), fan)
        self.buckets = buckets

    def hashed(self, df: DataFrame, key: str) -> DataFrame:
        keys = df.select(F.col(_name(key)).alias("_key"))
        return keys.withColumn("_hash", F.xxhash64("_key")).withColumn("_bucket", F.pmod("_hash", F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, level: int, batch: int) -> str:
        # The number of words in a bucket's filter is part of the name, as a reader needs it to find a key's word.
        staged = _join(self.root, f"level{level}-{batch}-0", "keys")
        df.write.mode("overwrite").partitionBy("_bucket").parquet(staged)
        stored = self.spark.read.schema(df.schema).parquet(staged)
        words = max(stored.count() // (self.buckets * KEYS_A_WORD), 1)
        place = self._place(words)
        filters = stored.groupBy("_bucket", place.alias("_place")).agg(F.bit_or(_marks()).alias("bits"))
        filters.repartition("_bucket").sortWithinPartitions("_bucket", "_place").write.mode("overwrite").partitionBy("_bucket").parquet(
            _join(self.root, f"level{level}-{batch}-0", "filter"))
        name = f"level{level}-{batch}-{words}"
        self._files().delete(self._path(name), True)
        self._files().rename(self._path(f"level{level}-{batch}-0"), self._path(name))
        return name

    @staticmethod
    def _place(words: int) -> Column:
        # The hash's upper part: the lower one has chosen the bucket.
        return F.pmod(F.shiftright("_hash", 20), F.lit(words))

    def _read(self, names: list[str], schema: StructType) -> DataFrame:
        out = None
        for name in names:
            part = self.spark.read.schema(schema).parquet(_join(self.root, name, "keys"))
            out = part if out is None else out.unionByName(part)
        return out

    def suspects(self, hashed: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of ``hashed`` whose key a filter may hold: all keys seen, and few others."""
        out = hashed.limit(0)
        for _, name in self.live(before):
            words = int(name.rsplit("-", 1)[1])
            filters = self.spark.read.schema(_FILTER).parquet(_join(self.root, name, "filter"))
            tested = hashed.withColumn("_place", self._place(words)).join(filters, ["_bucket", "_place"])
            out = out.unionByName(tested.where(F.col("bits").bitwiseAND(_marks()) == _marks()).select(hashed.columns))
        return out

    def seen(self, hashed: DataFrame, before: int | None = None, staged: str | None = None) -> DataFrame:
        """The rows of ``hashed`` whose key is in a table; only buckets with a suspect are read. Suspects are
        written to ``staged``, if given, so that the filters are read once."""
        tables = [name for _, name in self.live(before)]
        if not tables:
            return hashed.limit(0)
        suspects = self.suspects(hashed, before)
        if staged:
            suspects.write.mode("overwrite").parquet(staged)
            suspects = self.spark.read.schema(hashed.schema).parquet(staged)
        hit = [r[0] for r in suspects.select("_bucket").distinct().collect()]  # self.buckets at most
        if not hit:
            return hashed.limit(0)
        stored = self._read(tables, hashed.schema).where(F.col("_bucket").isin(hit))
        s, k = suspects.distinct().alias("s"), stored.alias("k")
        same = (F.col("s._bucket") == F.col("k._bucket")) & (F.col("s._hash") == F.col("k._hash")) & F.col("s._key").eqNullSafe(F.col("k._key"))
        return s.join(k, same, "left_semi")


def first_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, ties by the other columns."""
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*[F.col(_name(c)) for c in [*order, *rest]])
    firsts = df.groupBy(F.col(_name(key)).alias("_key")).agg(F.min(row).alias("_row"))
    return firsts.select([F.col(f"_row.{_name(c)}").alias(c) for c in df.columns])


def take_new(df: DataFrame, batch: int, table: KeyTable, out: str, key: str, order: Sequence[str]) -> None:
    """Write the rows of a batch whose key is new under ``out``/batch_id=<batch>, and add their keys."""
    spark = table.spark
    staged = _join(table.root, "incoming", str(batch))
    first_rows(df, key, order).write.mode("overwrite").parquet(_join(staged, "rows"))
    rows = spark.read.schema(df.schema).parquet(_join(staged, "rows"))
    known = table.seen(table.hashed(rows, key), batch, _join(staged, "suspects")).select("_key")
    new = rows.alias("r").join(known.alias("n"), F.col(f"r.{_name(key)}").eqNullSafe(F.col("n._key")), "left_anti")
    target = _join(out, f"batch_id={batch}")
    new.write.mode("overwrite").parquet(target)
    table.add(table.hashed(spark.read.schema(df.schema).parquet(target), key), batch)
    table._files().delete(table._path("incoming", str(batch)), True)


def run_intake(stream: DataFrame, name: str, key: str = "transaction_code", order: Sequence[str] = (), buckets: int = BUCKETS,
               fan: int = 4, timeout_s: int = 1800, base: str | None = None) -> DataFrame:
    """Each key's first row, with the ``batch_id`` that it came in; a later run on the same ``base`` goes on."""
    spark = stream.sparkSession
    root = base or scratch(spark, f"stream-{name}")
    out = _join(root, "data")
    table = KeyTable(spark, _join(root, "seen"), buckets, fan)
    writer = stream.writeStream.option("checkpointLocation", _join(root, "checkpoint")).trigger(availableNow=True)
    finish(writer.foreachBatch(lambda df, epoch: take_new(df, epoch, table, out, key, order)).start(), name, timeout_s)
    schema = StructType(stream.schema.fields).add("batch_id", IntegerType())
    try:
        return spark.read.schema(schema).parquet(out)
    except AnalysisException:  # no batch yet: nothing was written
        return spark.createDataFrame([], schema)
