"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm.language_id import held_out, identify, train
from sightline.llm.registry import llm_query
from sightline.llm.tables import table


@llm_query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents with remainder 2 take no part in training."""
    documents = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"))
    model = train(documents.where(~held & F.col("doc_id").isNotNull()).select("text", "lang"))
    return identify(documents.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")
