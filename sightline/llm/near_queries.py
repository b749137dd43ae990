"""Query of the near-duplicate classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.near_dedup import near_duplicate_classes
from sightline.llm.registry import llm_query
from sightline.llm.tables import table


@llm_query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents")).drop("_digest")
