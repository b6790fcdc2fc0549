"""The queries of the subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumspark.llm import exact_dedup, katz, packing, piece_viterbi, quality_fm, simhash, tool_calls, toxicity, warc, webp
from vellumspark.llm.common import read_table


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.contract(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read_table(spark, sf_dir, "documents"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.contract(read_table(spark, sf_dir, "conversations"))


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.contract(read_table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.contract(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.contract(read_table(spark, sf_dir, "documents"))


def op9_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.encode(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_fm": op1_quality_fm,
        "op2_tool_calls": op2_tool_calls,
        "op3_webp": op3_webp,
        "op4_toxicity": op4_toxicity,
        "op5_warc": op5_warc,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_simhash": op7_simhash,
        "op8_packing": op8_packing,
        "op9_piece_viterbi": op9_piece_viterbi,
        "op10_katz": op10_katz,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_calls": tool_calls.SQL, "op6_exact_dedup": exact_dedup.SQL}
