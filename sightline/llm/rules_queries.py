"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import quality_rules as rules
from sightline.llm.registry import llm_query
from sightline.llm.tables import table


def _value(measure: str) -> str:
    top, bottom, scale = rules.MEASURES[measure]
    return f"CASE WHEN {bottom} > 0 THEN ({top} * {scale}) // {bottom} ELSE 0 END"


_PAIRS = " UNION ALL ".join(
    f"SELECT lang, source, '{m}' AS measure, {_value(m)} AS v FROM counts WHERE NOT base_failed" for m in rules.MEASURES)


def _above(measure: str) -> str:
    top, bottom, scale = rules.MEASURES[measure]
    fence = (
        f"(SELECT fence FROM best b WHERE b.measure = '{measure}' AND b.lang IS NOT DISTINCT FROM c.lang "
        "AND b.source IS NOT DISTINCT FROM c.source)")
    return f"coalesce(sqrt({top}) > {fence} * sqrt({bottom} / {scale}::DOUBLE) + {rules.CHANCE}::DOUBLE, false)"


_ABOVE = " OR ".join(_above(m) for m in rules.MEASURES)
_SPACE = r"[\x20\x09-\x0D]"

SQL = rf"""
WITH rowed AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM rowed),
windows AS (SELECT rid, i, list_slice(words, i, i + 4) AS w FROM worded, unnest(range(1, len(words) - 3)) AS t(i)
    WHERE len(words) >= 5),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM repeated, unnest(range(0, 5)) AS t(j) GROUP BY rid),
counts AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '{_SPACE}+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(words) < {rules.MIN_WORDS} OR 100 * coalesce(c.n, 0) > {rules.MAX_REPEAT_PERCENT} * len(words) AS base_failed
    FROM worded w LEFT JOIN covered c USING (rid)),
vals AS ({_PAIRS}),
cells AS (SELECT lang, source, measure, v - v % (1::BIGINT << greatest(length(bin(v)) - {rules.SKETCH_BITS}, 0)) AS bucket
    FROM vals),
levels AS (SELECT 0 AS level, * FROM cells UNION ALL SELECT 1, lang, NULL, measure, bucket FROM cells
    UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM cells),
quantiles AS (SELECT level, lang, source, measure, count(*) AS total, sqrt(quantile_disc(bucket, 0.25)) AS q1,
    sqrt(quantile_disc(bucket, 0.75)) AS q3, sqrt(quantile_disc(bucket, {rules.TAIL} / 10)) AS tail FROM levels GROUP BY ALL),
fences AS (SELECT *, CASE WHEN level = 0 OR q3 > q1 THEN q3 - q1 ELSE tail - q3 END AS spread FROM quantiles
    WHERE total >= {rules.MIN_GROUP} OR level = 2),
pairs AS (SELECT DISTINCT lang, source FROM counts),
best AS (SELECT p.lang, p.source, f.measure,
    arg_min(f.q3, f.level) + {rules.FENCE} * coalesce(arg_min(f.spread, f.level) FILTER (f.spread > 0), 0) AS fence
    FROM pairs p JOIN fences f ON f.level = 2 OR (f.level = 1 AND f.lang IS NOT DISTINCT FROM p.lang)
    OR (f.level = 0 AND f.lang IS NOT DISTINCT FROM p.lang AND f.source IS NOT DISTINCT FROM p.source) GROUP BY ALL)
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words,
    base_failed, NOT base_failed AND NOT ({_ABOVE}) AS kept FROM counts c
"""


@llm_query("op8_quality_rules", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and adaptive verdict of every document."""
    return rules.judge_quality(table(spark, sf_dir, "documents"))
