"""Importance resampling towards a target text collection.

Every document is a bag of hashed runs of one to three words. A bucket's gain is
the log ratio of its share in the target to its share in the documents; a document's
weight is the sum of its gains, and a Gumbel key from a hash of its id turns the top
weights into a draw without replacement.

Counting is by batch concatenation: the texts of a batch are joined with separator
sentinels, one regex pass finds all words, ``searchsorted`` over the documents' offsets
gives each word its document, n-grams that cross documents are masked and
``bincount`` adds up the buckets. The checksum of an n-gram is combined from its words'
checksums, as CRC-32 is linear: crc(a + b) = shift(crc(a), len(b)) ^ crc(b).

Plan: one pass over the documents and one over the target count the buckets (a task hands on at
most one row per bucket, which Spark adds up); the gains, one number a bucket, go to the
tasks of a second pass, which gives every document its weight. Only (id, score) rows
are then sorted by range; the rank is the place in the range plus the rows of earlier ranges.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as the
empty string and comes last among ties; very long texts are whole (words go through in blocks,
two words are carried over); repeated rows each get their row, and their rank if drawn; an empty
table gives no rows, an empty target equal shares; only id and text are read of the input's columns.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import text_of, written

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
LONGEST = 3  # words of the longest feature

BATCH_BYTES = 1 << 21
BLOCK = 1 << 18  # words held at once, of a text of any length
SENTINEL = b"\0"  # no word character
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TABLED = 64  # byte lengths whose checksum shift is tabled; longer words are summed directly


def _shift_table() -> np.ndarray:
    """[length, byte place, byte value] -> CRC-32 register after that many zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    table = np.empty((TABLED, 4, 256), dtype=np.uint32)
    table[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    for length in range(1, TABLED):
        before = table[length - 1]
        table[length] = one[before & 0xFF] ^ (before >> 8)
    return table.ravel()


def _shift(table: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    base = length * 1024
    return (table[base + (crc & 0xFF)] ^ table[base + 256 + (crc >> 8 & 0xFF)]
            ^ table[base + 512 + (crc >> 16 & 0xFF)] ^ table[base + 768 + (crc >> 24)])


def features(texts: list[bytes], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text number, checksum) of every word run of a batch, block by block, with its words per run."""
    whole = SENTINEL.join(texts).lower()  # bytes: A-Z only
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    space = np.uint32(zlib.crc32(b" "))
    found = WORD.finditer(whole)
    words: list[bytes] = []
    starts: list[int] = []
    old = 0  # words carried over from the block before
    while block := list(islice(found, BLOCK)):
        words = words[-2:] + [m[0] for m in block]
        starts = starts[-2:] + [m.start() for m in block]
        n = len(words)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        crc = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=n)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        long = size >= TABLED - 1
        small = np.where(long, 0, size)
        yield doc[old:], crc[old:], 1
        then = _shift(table, crc, np.ones(n, dtype=np.int64)) ^ space  # the word and a space
        two = _shift(table, then[:-1], small[1:]) ^ crc[1:]
        three = _shift(table, _shift(table, then[:-2], small[1:-1] + 1) ^ then[1:-1], small[2:]) ^ crc[2:]
        for k in np.flatnonzero(long).tolist():  # no table for these: sum the runs that a long word follows in
            if k >= 1:
                two[k - 1] = zlib.crc32(b" ".join(words[k - 1:k + 1]))
            for last in (k, k + 1):
                if 2 <= last < n:
                    three[last - 2] = zlib.crc32(b" ".join(words[last - 2:last + 1]))
        for run, sums in ((2, two), (3, three)):
            first = max(old - run + 1, 0)  # runs that end in a new word
            inside = doc[first:n - run + 1] == doc[first + run - 1:]
            yield doc[first + run - 1:][inside], sums[first:][inside], run
        old = min(n, 2)


def _batches(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column in lists of bounded size, one text at least."""
    texts, size = [], 0
    for text in column.to_pylist():
        if texts and size + len(text) > BATCH_BYTES:
            yield texts
            texts, size = [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield texts


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts, counted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _shift_table()
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for texts in _batches(batch.column(0)):
                for _, crc, _ in features(texts, table):
                    counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    parts = rows.select(text_of().cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket; one number a bucket is all that reaches the driver."""
    held = np.zeros((2, buckets), dtype=np.int64)
    for k, rows in enumerate((docs, target)):
        for r in bucket_counts(rows, buckets).collect():  # at most ``buckets`` rows
            held[k, r.bucket] = r.n
    (s, t), (all_s, all_t) = held.tolist(), held.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log(float((tb + 1) * (all_s + buckets)) / float((sb + 1) * (all_t + buckets))))
                     for sb, tb in zip(s, t)], dtype=np.int64)


def importance_scores(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", buckets: int = BUCKETS,
                      seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each document, towards the ``target`` texts."""
    gain = gains(docs, target, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _shift_table()
        for batch in batches:
            out = [[], [], []]
            for texts in _batches(batch.column(1)):
                n = len(texts)
                n_words, n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                for doc, crc, length in features(texts, table):
                    per_text = np.bincount(doc, minlength=n)
                    n_features += per_text
                    if length == 1:
                        n_words += per_text
                    # Sums of integers below 2^53 are exact in doubles.
                    weight += np.bincount(doc, weights=gain[crc % np.uint32(buckets)], minlength=n)
                for held, part in zip(out, (n_words, n_features, weight.astype(np.int64))):
                    held.append(part)
            if out[0]:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(x)) for x in out]],
                                                 names=["id", "n_words", "n_features", "weight"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    weighted = docs.select(F.col(id_column).alias("id"), text_of().cast("binary").alias("text")).mapInArrow(run, schema)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    key = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + key).withColumnRenamed("id", id_column)


def draw(scores: DataFrame, id_column: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, ... for the highest scores among documents of ``min_words``
    words or more, up to ``percent`` of these; null for the others."""
    # The row number parts rows that are equal in all else, so that no range has to hold them together.
    rows = written(scores.withColumn("_row", F.monotonically_increasing_id()), "resample")
    may = F.col("n_words") >= min_words
    order = [F.desc("score"), F.asc_nulls_last(id_column), F.asc("_row")]
    ordered = written(rows.where(may).repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("_at", F.monotonically_increasing_id()), "resample-order")
    # An id of these is the partition's number, then the row's place in 33 bits.
    place, part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy()).alias("_all"))
    at = F.col("_before") + place + 1
    ranked = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        "rank", F.when(at <= F.floor(F.col("_all") * percent / 100), at))
    return ranked.select(*scores.columns, "rank").unionByName(
        rows.where(~may).select(*scores.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The documents whose id was drawn, with all their columns."""
    drawn = draw(importance_scores(docs, target, id_column), id_column, percent).where("rank IS NOT NULL")
    return docs.join(drawn.select(F.col(id_column).alias("_drawn")).distinct(),
                     F.col(id_column).eqNullSafe(F.col("_drawn")), "left_semi")


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Features, weight, score and rank per document."""
    return draw(importance_scores(docs, target)).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
