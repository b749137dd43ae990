"""Query of the search for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.llm.personal_data import find_personal_data
from sightline.llm.pii_labelers import BASE_KINDS
from sightline.llm.registry import llm_query
from sightline.llm.tables import table


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@llm_query("op12_personal_data")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, digest of the base spans, and all spans of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [_number(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
