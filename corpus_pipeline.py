"""The corpus pipeline: five stages over ``documents``, and the registry of all queries of the subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as Parquet
to the checkpoint folder and hands it, reread, to the next stage.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm import decontaminate, near_dedup, packing, quality_classifier, substring_dedup
from sightline.llm.queries import LLM_QUERIES
from sightline.llm.registry import llm_query
from sightline.llm.tables import table
from sightline.session import collect_written, ensure_checkpoint_dir, release_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Tables that the newest stage wrote for itself; the next stage releases those it does not read.
_WRITTEN: list[str] = []


def _stage(body: Stage) -> Stage:
    """A stage whose predecessor's result has been written, so that the predecessor's own tables can go."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_paths(spark, _WRITTEN, still_read=docs)
        with collect_written(_WRITTEN):
            return body(spark, docs, sf_dir)

    run_stage.__doc__ = body.__doc__
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; trained on ``labels`` of the documents at hand."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, prefix="_own_").where("_own_kept").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id."""
    return near_dedup.drop_near_duplicates(docs)


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; a document that consists of nothing else goes."""
    cut = substring_dedup.remove_repeated(docs, prefix="_own_")
    length = F.when(F.col("_own_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    kind = docs.schema["n_chars"].dataType
    return (
        cut.where("_own_n_removed = 0 OR _own_n_removed < _own_n_words").withColumn("n_chars", length.cast(kind)).select(*docs.columns))


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of the benchmark; contaminated documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="document")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", benchmark),
    ("packing", pack),
]

# SQL has no tokenizer and no classifier; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark)}/sightline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            release_paths(spark, [before])
        before = path
    release_paths(spark, _WRITTEN, still_read=docs)
    return docs


llm_query("pipeline", ORACLE_SQL)(run)

ALL_QUERIES = LLM_QUERIES
