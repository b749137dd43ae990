"""Query of the filter interaction audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import filter_audit as audit
from sightline.llm.registry import llm_query
from sightline.llm.tables import table

_PLACES = range(1, len(audit.LETTERS) + 1)
_DISTINCT = " AND ".join(f"l{i}.letter <> l{j}.letter" for i in _PLACES for j in _PLACES if i < j)

SQL = rf"""
WITH rowed AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part
    FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(text, '{audit.SPACE}'), lambda x: x <> '') AS words FROM rowed),
first_of AS (SELECT text, min(doc_id) AS least FROM rowed GROUP BY text),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)
    AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < {audit.MIN_WORDS})::INT
    + 2 * (100 * len(list_distinct(words)) < {audit.MIN_DISTINCT_PERCENT} * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {audit.MAX_CAPITALS_PERCENT} * length(text))::INT
    + 8 * regexp_matches(text, '{audit.SYMBOLS}')::INT + 16 * coalesce(w.doc_id > f.least, false)::INT AS mask
    FROM worded w JOIN first_of f USING (text) LEFT JOIN known k ON k.doc_id = w.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM judged GROUP BY ALL),
letters AS (SELECT substr('{audit.LETTERS}', i::INT, 1) AS letter, 1 << (i - 1)::INT AS bit FROM range(1, 6) AS t(i)),
orders AS (SELECT {" || ".join(f"l{i}.letter" for i in _PLACES)} AS filter_order,
    [{", ".join(f"l{i}.bit" for i in _PLACES)}] AS bits
    FROM {", ".join(f"letters l{i}" for i in _PLACES)} WHERE {_DISTINCT}),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
    FROM orders, range(1, 6) AS t(s)),
counted AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""


@llm_query("op13_filter_audit", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters over all documents, per source."""
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
