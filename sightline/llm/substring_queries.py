"""Query of the substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm.registry import llm_query
from sightline.llm.substring_dedup import WINDOW, remove_repeated
from sightline.llm.tables import table

SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT rid, i, md5(array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ')) AS w
    FROM docs, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i) WHERE len(words) >= {WINDOW}),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
covered AS (SELECT rid, list_distinct(flatten(list(range(i, i + {WINDOW})))) AS gone FROM windows SEMI JOIN often USING (w) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, len(coalesce(gone, []))::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
        list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN covered USING (rid)
"""


@llm_query("op9_substring_dedup", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed words of every document, and a digest of the words that stay."""
    found = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
