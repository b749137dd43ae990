"""Query of the packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.packing import pack
from sightline.llm.registry import llm_query
from sightline.llm.tables import table


@llm_query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
