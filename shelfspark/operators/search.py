"""FLT-2 with stems: an inverted index over item name and description, and searches that read its terms only.

`write_index` turns every item into (stem, item) postings: words are lower-cased, stop words dropped, the rest stemmed
(`functions.stems`), each stem once per item with the number of its words. Postings are dealt to ``buckets`` folders by the
stem's hash and, inside, ranged by (stem, item): a stem that a third of the items hold is split over several files, and a
file's statistics tell its stems. `search` stems the query in the same way, so it reads the folders of its stems and in
these the row groups that may hold them, not the items.

Items: null or empty texts have no postings and are never found. A null id is indexed as such.
Repeated ids count as one item, found if any of its rows holds a stem. Queries: all words (``match_all``) or any; a query
without a word beside stop words finds nothing, as in a text index; repeated words count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.stems import STOP_WORDS, stem
from shelfspark.operators.access import text_tokens

BUCKETS = 32


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("stem"), F.lit(buckets)).cast("int")


def stems_of(texts: DataFrame, id_col: str, text) -> DataFrame:
    """(``id_col``, stem, words) of every text; ``text`` is a column expression."""
    words = texts.select(F.col(f"`{id_col}`"), F.explode(text_tokens(text)).alias("_token"))
    stems = words.where(~F.col("_token").isin(STOP_WORDS)).select(F.col(f"`{id_col}`"), stem(F.col("_token")).alias("stem"))
    return stems.groupBy(F.col(f"`{id_col}`"), "stem").agg(F.count("*").alias("words"))


def write_index(items: DataFrame, path: str, id_col: str = "item_id", buckets: int = BUCKETS) -> str:
    text = F.concat_ws(" ", F.col("item_name"), F.col("description"))
    rows = stems_of(items, id_col, text).withColumn("bucket", _bucket(buckets))
    rows = rows.repartitionByRange("bucket", "stem", F.col(f"`{id_col}`")).sortWithinPartitions("bucket", "stem")
    rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#stem", "true").partitionBy("bucket").parquet(path)
    return path


def query_stems(spark: SparkSession, query: str) -> list[str]:
    """The stems of a query's words, once each."""
    asked = spark.createDataFrame([(0, query)], "q int, text string")
    return sorted(r.stem for r in stems_of(asked, "q", F.col("text")).collect())  # the words of one query


def postings(spark: SparkSession, path: str, stems: Sequence[str], id_col: str = "item_id", id_type: str = "bigint",
             buckets: int = BUCKETS) -> DataFrame:
    """The index rows of some stems: bucket folders are chosen by name, row groups by stem."""
    asked = spark.createDataFrame([(s,) for s in stems], "stem string")
    at = sorted({r[0] for r in asked.select(_bucket(buckets)).collect()})  # of the query's words
    index = spark.read.schema(f"`{id_col}` {id_type}, stem string, words bigint, bucket int").parquet(path)
    return index.where(F.col("bucket").isin(at) & F.col("stem").isin(list(stems))).drop("bucket")


def search(items: DataFrame, path: str, query: str, match_all: bool = True, id_col: str = "item_id",
           buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``items`` that hold the query's stems, with ``n_words``: how many of their words have one."""
    spark = items.sparkSession
    stems = query_stems(spark, query)
    if not stems:
        return items.withColumn("n_words", F.lit(None).cast("bigint")).limit(0)
    hits = postings(spark, path, stems, id_col, items.schema[id_col].dataType.simpleString(), buckets)
    found = hits.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.count("*").alias("_n"), F.sum("words").alias("n_words"))
    if match_all:
        found = found.where(F.col("_n") == len(stems))  # a stem is one row per item
    return items.join(found.drop("_n"), F.col(f"`{id_col}`").eqNullSafe(F.col("_id"))).drop("_id")
