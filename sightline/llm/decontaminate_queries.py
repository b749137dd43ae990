"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.decontaminate import WINDOW, contamination_digest, find_contamination
from sightline.llm.registry import llm_query
from sightline.llm.tables import table

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
bench AS (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
grams AS (SELECT DISTINCT item_id, least(len(words), {WINDOW}) AS size,
    list_slice(words, i, i + least(len(words), {WINDOW}) - 1) AS w
    FROM bench, unnest(range(1, greatest(len(words) - {WINDOW - 1}, least(len(words), 1)) + 1)) AS t(i)),
sizes AS (SELECT DISTINCT size FROM grams),
found AS (SELECT d.rid, i, s.size, g.item_id FROM docs d CROSS JOIN sizes s,
    unnest(range(1, len(d.words) - s.size + 2)) AS t(i)
    JOIN grams g ON g.size = s.size AND g.w = list_slice(d.words, i, i + s.size - 1)),
hits AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, size)) AS t(j) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""


@llm_query("op2_decontamination", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark windows in every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(find_contamination(documents, table(spark, sf_dir, "benchmark")))
