"""A corpus pipeline over documents: STAGES, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridex.llm import _io
from veridex.llm.langid import known_language_stage
from veridex.llm.mixing import mix_stage
from veridex.llm.near_dup import one_of_each_stage
from veridex.llm.pieces import encode_stage
from veridex.llm.substring_dedup import substring_stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language_stage),
    ("near_duplicates", one_of_each_stage),
    ("substrings", substring_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: SQL expresses neither the classifier nor the suffix arrays; tests/llm holds near_duplicates and substrings against brute force, encode by round trips.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _io.materialize(stage(spark, docs, sf_dir), name)
    return docs
