"""Corpus pipeline: quality rules, near-duplicates, repeats, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the frame that is written
and read as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import packing, pii, quality, queries, simhash, suffix
from shelfspark.llm.common import noting, release, written
from shelfspark.session import configure


_WROTE: dict[int, list[str]] = {}  # stage -> the tables that its last call wrote on the way


def _stage(number: int, step: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stage before it wrote on the way: its rows
    have been written and reread as ``docs`` by then (tables that ``docs`` still reads stay)."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        release(_WROTE.get(number - 1, []), docs)
        _WROTE[number] = []
        with noting(_WROTE[number]):
            return step(docs)

    return run_stage


# Passages of over 50 words repeat across documents: no longer than 50 words that are short.
REPEAT_BYTES = 200


def _cut_repeats(docs: DataFrame) -> DataFrame:
    return suffix.remove_repeats(docs, REPEAT_BYTES)


def _pack(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [(name, _stage(k, step)) for k, (name, step) in enumerate([
    ("quality_rules", quality.filter_documents),
    ("simhash_near_dedup", simhash.deduplicate),
    ("suffix_array_dedup", _cut_repeats),
    ("personal_data", pii.redact),
    ("packing", _pack),
])]

# The later stages (hash fingerprints, suffix order, a trained classifier, a tokenizer) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
