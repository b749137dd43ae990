"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.quality_classifier import fit, score
from sightline.llm.registry import llm_query
from sightline.llm.tables import table


@llm_query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by both views."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", "p_text", "p_metadata", "score", "kept")
