"""Queries of the corpus operators and, where DuckDB can express one, the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setforge.llm.decontamination import op1_decontamination, op1_sql
from setforge.llm.html_extract import op4_html_extract
from setforge.llm.langid import op9_language_id
from setforge.llm.mixing import op3_mixing
from setforge.llm.quality_model import op5_quality_model
from setforge.llm.quality_rules import OP2_SQL, op2_quality_rules
from setforge.llm.simhash import op8_simhash
from setforge.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from setforge.llm.token_file import op10_token_file
from setforge.llm.tokens import op7_token_counts


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality_rules": op2_quality_rules,
        "op3_mixing": op3_mixing,
        "op4_html_extract": op4_html_extract,
        "op5_quality_model": op5_quality_model,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_simhash": op8_simhash,
        "op9_language_id": op9_language_id,
        "op10_token_file": op10_token_file,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": op1_sql(),
        "op2_quality_rules": OP2_SQL,
        "op6_substring_dedup": OP6_SQL,
    }
