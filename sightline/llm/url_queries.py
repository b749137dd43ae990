"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.registry import llm_query
from sightline.llm.tables import table
from sightline.llm.url_filter import judge_urls

RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)

SQL = f"""
WITH rules(rhost, rpath, action) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, row_number() OVER () AS rid,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rid, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM cut),
parts AS (SELECT page_id, rid, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split),
fit AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY rid ORDER BY
        length(rhost) + length(rpath) DESC NULLS LAST, length(rhost) DESC, action DESC, rhost || rpath DESC) AS k
    FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1
"""


@llm_query("op6_url_filter", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL; without a rule a URL is allowed."""
    rules = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(host, path, action)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
