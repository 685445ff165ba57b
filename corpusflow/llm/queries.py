"""Registered queries of the subpackage: thin contracts over the operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corpusflow.llm import filter_audit, forest, lattice_lm, main_text, mixing, ngram_join, packing, pii, quality_mil, secrets, sharding, spelling, sql, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, folder, "documents"))


@query
def op2_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.nearest(table(spark, folder, "embeddings"))


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_mil.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, folder, "documents"))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract_pages(table(spark, folder, "pages"))


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


@query
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, folder, "documents"))


@query
def op9_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, folder, "documents")))


@query
def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, folder, "documents"))).drop("source")


@query
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.ORACLES.items() if name in QUERIES}
