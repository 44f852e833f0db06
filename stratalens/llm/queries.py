"""Queries over the test tables that apply each operator of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import alignment, decontaminate, licences, linkgraph, oracles, packing, partenum, pii, pulearn, quality, sentences, suffixes, tokenfile, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.repeated(table(spark, sf_dir, "documents"), ends=True).drop("row")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), host="source").drop("common_lines")


def op8_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_link_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


def op10_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulearn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.repeats(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_file, op2_benchmark_leaks, op3_licence_scan, op4_similar_documents, op5_repeated_sentences, op6_personal_data, op7_quality_rules, op8_packed_windows, op9_link_verdicts, op10_positive_unlabelled,
                                   op11_repeated_bytes, op12_spelling_variants, op13_token_alignment)}
ORACLE_SQL: dict[str, str] = {"op4_similar_documents": oracles.SIMILAR, "op7_quality_rules": oracles.quality(), "op9_link_verdicts": linkgraph.oracle()}
