"""Query of the alignment of two tokenizers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from sightline.llm import token_alignment as alignment
from sightline.llm.registry import llm_query
from sightline.llm.tables import table

_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_SCHEMA = T.StructType([*[T.StructField(c, T.LongType()) for c in _COLUMNS], T.StructField("groups_sha256", T.StringType())])


def group_digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The numbers of each aligned document and the digest of its groups; without tokens it is empty."""
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in alignment.group_texts(batch)]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in _COLUMNS], pa.array(digests, pa.string())], _SCHEMA.names)


def aligned_digests(documents: DataFrame, **options) -> DataFrame:
    return alignment.align_tokenizers(documents, finish=group_digests, schema=_SCHEMA, **options)


@llm_query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over all documents."""
    return aligned_digests(table(spark, sf_dir, "documents"))
