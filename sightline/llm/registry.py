"""Registry of the queries of this subpackage: a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SparkQuery = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class LlmQuery:
    name: str
    run: SparkQuery
    sql: str | None


LLM_QUERIES: dict[str, LlmQuery] = {}


def llm_query(name: str, sql: str | None = None) -> Callable[[SparkQuery], SparkQuery]:
    def add(fn: SparkQuery) -> SparkQuery:
        LLM_QUERIES[name] = LlmQuery(name, fn, sql)
        return fn

    return add
