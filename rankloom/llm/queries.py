"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import checks, decontaminate, lexical, licenses, linededup, minhash, negatives, neighbours, packing, pii, quality, setjoin, tokenfile, urlfilter
from rankloom.llm.common import table

#: The installed package that holds vocabulary files; a path is a parameter of the operators.
WORD_VOCABULARY, WORD_END = public_tokenizers.path("word_bpe_49k.json"), 1
BYTE_VOCABULARY, BYTE_END = public_tokenizers.path("byte_bpe_50k.json"), 0

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def line_dedup_every_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"), min_words=1)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), WORD_VOCABULARY, WORD_END)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.report(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, BYTE_END)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.report(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(table(spark, sf_dir, "embeddings"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.report(table(spark, sf_dir, "documents"), size=4, percent=85)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_files": op3_token_files,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "line_dedup_every_run": line_dedup_every_run,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

CHECKS: dict[str, str] = {
    "op1_decontamination": checks.OP1,
    "op7_line_dedup": checks.OP7,
    "line_dedup_every_run": checks.LINE_DEDUP_EVERY_RUN,
    "op12_lexical_search": checks.OP12,
    "op13_hard_negatives": checks.OP13,
}
