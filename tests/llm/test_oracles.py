"""Queries with SQL against DuckDB, and the registry."""

from __future__ import annotations

import pytest

import workload.check as check
from sightline.llm.queries import LLM_QUERIES
from sightline.llm.registry import LlmQuery

SF = "/root/testdata/sf0.001"
WITH_SQL = [n for n, q in LLM_QUERIES.items() if q.sql]


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, con, name, monkeypatch):
    monkeypatch.setattr(check, "QUERIES", LLM_QUERIES)
    assert check.compare(spark, con, name, SF).startswith("ok")


def test_registry():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = set(entry.queries())
    assert {"pipeline"} <= names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert all(isinstance(q, LlmQuery) for q in LLM_QUERIES.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
