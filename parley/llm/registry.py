"""What ``__spark_entry__`` registers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from parley.llm import oracles
from parley.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        q.op1_lm_scores,
        q.op2_packing,
        q.op3_token_files,
        q.op4_url_filters,
        q.op5_exact_dedup,
        q.op6_ngram_join,
        q.op7_quality_rules,
        q.op8_substring_dedup,
        q.op9_language_id,
        q.op10_mixing,
        q.op11_vector_codes,
        q.op12_line_dedup,
        q.op13_collocations,
    )
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
