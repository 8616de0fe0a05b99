"""Registered queries of the operators and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import (ann, common, html, lm, packing, periodic, pieces, pii, prints, quality, resample, simhash,
                            suffix, tokencount)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op9_quality_rules", quality.report_sql())
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(common.documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(common.documents(spark, sf_dir, "doc_id", "text"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).drop("ids")


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats_report(common.documents(spark, sf_dir, "doc_id", "text"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(common.documents(spark, sf_dir, "doc_id", "text"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return tokencount.token_counts(docs, tokenizer_path("word_bpe_49k.json"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).drop("ids")


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


@query("op7_lm_scores")
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(common.documents(spark, sf_dir, "doc_id", "text"))


@query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


@query("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample.resampling_report(common.documents(spark, sf_dir, "doc_id", "text"), benchmark)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    return periodic.periodic_report(docs, edit=periodic.replant)


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.fingerprint_report(common.documents(spark, sf_dir, "doc_id", "text"))
