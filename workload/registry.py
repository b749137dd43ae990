"""Registry of queries: a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from workload.views import round_doubles
from workload.views_sql import with_ctes

SparkQuery = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: SparkQuery
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(
    name: str,
    sql: str | None = None,
    needs: tuple[str, ...] = (),
    doubles: str = "",
    digits: int = 6,
) -> Callable[[SparkQuery], SparkQuery]:
    """Register a query; ``doubles`` lists the oracle's double columns to round."""
    def add(fn: SparkQuery) -> SparkQuery:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return round_doubles(fn(spark, sf), digits)

        text = None
        if sql is not None:
            text = with_ctes(needs, sql)
            names = doubles.split()
            if names:
                fixes = ", ".join(
                    f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in names)
                text = f"SELECT * REPLACE ({fixes}) FROM (\n{text}\n)"
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, run, text)
        return fn

    return add
