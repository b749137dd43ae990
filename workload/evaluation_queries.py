"""Metrics, failure breakdowns, statistics, calibration and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions.labels import hit, pixel_error
from sightline.operators import calibrate as cal
from sightline.operators import compare as cmp
from sightline.operators import frames as fr
from sightline.operators import metrics as mt
from sightline.operators import stats as st
from sightline.operators import strata as sr
from sightline.operators.ordering import exact_quantiles
from workload import views as v
from workload.registry import query

METRICS = (
    "n_frames n_positive n_negative fpr_at_threshold recall_at_threshold hit_rate_n3 hit_rate_n4 "
    "fraction_localized mean_pixel_error median_pixel_error presence_auroc").split()
RATES = " ".join(METRICS[3:])


def metric_sql(source: str, keys: str) -> str:
    """All metrics of ``source`` grouped by ``keys``; AUROC from average ranks."""
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {by}count(*) AS n_frames, count(*) FILTER (WHERE is_positive) AS n_positive,
  count(*) FILTER (WHERE NOT is_positive) AS n_negative,
  avg(CAST(conf >= 0.5 AS INTEGER)) FILTER (WHERE NOT is_positive) AS fpr_at_threshold,
  avg(CAST(conf >= 0.5 AS INTEGER)) FILTER (WHERE is_positive) AS recall_at_threshold,
  avg(CAST(coalesce(raw_err <= 3, false) AS INTEGER)) FILTER (WHERE is_positive) AS hit_rate_n3,
  avg(CAST(coalesce(raw_err <= 4, false) AS INTEGER)) FILTER (WHERE is_positive) AS hit_rate_n4,
  avg(CAST(raw_err IS NOT NULL AS INTEGER)) FILTER (WHERE is_positive) AS fraction_localized,
  avg(raw_err) FILTER (WHERE is_positive) AS mean_pixel_error,
  quantile_cont(raw_err, 0.5) FILTER (WHERE is_positive) AS median_pixel_error,
  CASE WHEN count(*) FILTER (WHERE is_positive) > 0 AND count(*) FILTER (WHERE NOT is_positive) > 0 THEN
    (sum(r) FILTER (WHERE is_positive) - CAST(count(*) FILTER (WHERE is_positive) AS DOUBLE) * (count(*) FILTER (WHERE is_positive) + 1) / 2)
    / (CAST(count(*) FILTER (WHERE is_positive) AS DOUBLE) * count(*) FILTER (WHERE NOT is_positive)) END AS presence_auroc
FROM (
  SELECT *, rank() OVER ({part} ORDER BY conf) + CAST(count(*) OVER (PARTITION BY {by} conf) - 1 AS DOUBLE) / 2 AS r
  FROM (SELECT *, coalesce(pred_confidence, 0) AS conf FROM ({source}))) {group}
"""


def long_sql(wide: str, keys: str) -> str:
    parts = [
        f"SELECT {keys}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({wide}) WHERE {m} IS NOT NULL"
        for m in METRICS]
    return " UNION ALL ".join(parts)


def sliced_sql(source: str) -> str:
    return f"""
SELECT * FROM (SELECT x.*, unnest(['overall', 'wavelength_' || wavelength,
    CASE WHEN line_confidence IS NULL OR n < 4 THEN NULL WHEN line_confidence <= e1 THEN 'line_q1' WHEN line_confidence <= e2 THEN 'line_q2'
         WHEN line_confidence <= e3 THEN 'line_q3' ELSE 'line_q4' END]) AS slice
FROM {source} x, (SELECT count(line_confidence) AS n, quantile_cont(line_confidence, 0.25) AS e1,
  quantile_cont(line_confidence, 0.5) AS e2, quantile_cont(line_confidence, 0.75) AS e3 FROM {source})) WHERE slice IS NOT NULL
"""


@query("evaluate_val", long_sql(metric_sql(sliced_sql("val_frame"), "slice"), "slice"), ("val_frame",), "value")
def evaluate_val(spark, sf):
    return mt.evaluate(
        v.predictions(spark, sf), v.frames(spark, sf), v.splits(spark, sf), v.tags(spark, sf),
        v.lines(spark, sf), "val")


@query("evaluate_all_dives", long_sql(metric_sql(sliced_sql("per_frame"), "slice"), "slice"), ("per_frame",), "value")
def evaluate_all_dives(spark, sf):
    return mt.evaluate_joined(v.per_frame(spark, sf))


@query("hit_rate_val", """
SELECT count(*) AS n_frames, count(*) FILTER (WHERE is_positive) AS n_positive,
  avg(CAST(coalesce(raw_err <= 3, false) AS INTEGER)) FILTER (WHERE is_positive) AS hit_rate_n3,
  avg(raw_err) FILTER (WHERE is_positive) AS mean_pixel_error FROM val_frame
""", ("val_frame",), "hit_rate_n3 mean_pixel_error")
def hit_rate_val(spark, sf):
    rows = v.per_frame(spark, sf, "val").withColumn("err", pixel_error())
    pos = F.col("is_positive")
    return rows.agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_if(pos).alias("n_positive"),
        F.avg(F.when(pos, hit(F.col("err"), 3).cast("double"))).alias("hit_rate_n3"),
        F.avg(F.when(pos, F.col("err"))).alias("mean_pixel_error"))


@query("core_metrics", metric_sql("SELECT * FROM per_frame", ""), ("per_frame",), RATES)
def core_metrics(spark, sf):
    return mt.core_metrics(v.joined(spark, sf))


@query("metrics_by_rig", metric_sql("SELECT * FROM per_frame", "rig_id"), ("per_frame",), RATES)
def metrics_by_rig(spark, sf):
    return mt.core_metrics(v.joined(spark, sf), ["rig_id"])


@query("presence_auroc_by_dive", f"SELECT dive_id, presence_auroc FROM ({metric_sql('SELECT * FROM per_frame', 'dive_id')})",
       ("per_frame",), "presence_auroc")
def presence_auroc_by_dive(spark, sf):
    return mt.auroc(v.joined(spark, sf), ["dive_id"], "pred_confidence", F.col("is_positive"))


FAN_OUT = """
SELECT f.*, p.pred_x, p.pred_y, p.pred_confidence,
  sqrt((p.pred_x - f.label_x) * (p.pred_x - f.label_x) + (p.pred_y - f.label_y) * (p.pred_y - f.label_y)) AS raw_err
FROM (SELECT * FROM frames JOIN splits USING (dive_id) WHERE split = 'val') f LEFT JOIN (
  SELECT image_id, pred_x, pred_y, pred_confidence FROM predictions
  UNION ALL SELECT image_id, pred_x + 1, pred_y - 1, pred_confidence / 2 FROM predictions WHERE image_id % 4 = 0) p USING (image_id)
"""


def _doubled_predictions(spark, sf) -> DataFrame:
    p = v.predictions(spark, sf)
    again = p.filter(F.col("image_id") % 4 == 0).withColumn("pred_x", F.col("pred_x") + F.lit(1)).withColumn(
        "pred_y", F.col("pred_y") - F.lit(1)).withColumn("pred_confidence", F.col("pred_confidence") / F.lit(2))
    return p.unionByName(again)


@query("duplicate_predictions", metric_sql(FAN_OUT, ""), ("frames", "predictions", "splits"), RATES)
def duplicate_predictions(spark, sf):
    return mt.core_metrics(fr.join_predictions(
        v.frames(spark, sf), _doubled_predictions(spark, sf), v.splits(spark, sf), v.tags(spark, sf),
        v.lines(spark, sf), "val"))


@query("deduplicated_predictions", metric_sql("SELECT * FROM val_frame", ""), ("val_frame",), RATES)
def deduplicated_predictions(spark, sf):
    p = v.predictions(spark, sf)
    # The weaker copy of a prediction without a point must not win over it.
    doubled = p.unionByName(p.withColumn("pred_confidence", F.col("pred_confidence") - F.lit(1)))
    return mt.core_metrics(fr.join_predictions(
        v.frames(spark, sf), doubled, v.splits(spark, sf), v.tags(spark, sf), v.lines(spark, sf), "val", True))


CONTESTED = """
SELECT f.*, p.pred_x, p.pred_y, p.pred_confidence,
  sqrt((p.pred_x - f.label_x) * (p.pred_x - f.label_x) + (p.pred_y - f.label_y) * (p.pred_y - f.label_y)) AS raw_err
FROM (SELECT * FROM frames JOIN splits USING (dive_id) WHERE split = 'val') f LEFT JOIN (
  SELECT image_id, pred_x, pred_y, pred_confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pred_confidence DESC, pred_x NULLS LAST, pred_y NULLS LAST) AS place FROM (
      SELECT image_id, pred_x, pred_y, pred_confidence FROM predictions
      UNION ALL SELECT image_id, pred_x - 1, pred_y + 1, pred_confidence + CASE WHEN image_id % 3 = 0 THEN 0.25 ELSE 0 END
        FROM predictions WHERE image_id % 3 < 2
      UNION ALL SELECT image_id, NULL, NULL, pred_confidence FROM predictions WHERE image_id % 5 = 0))
  WHERE place = 1) p USING (image_id)
"""


@query("contested_predictions", metric_sql(CONTESTED, ""), ("frames", "predictions", "splits"), RATES)
def contested_predictions(spark, sf):
    """Copies that win by confidence, that tie and win by their point, and that tie but have no point."""
    p, image = v.predictions(spark, sf), F.col("image_id")
    copies = p.where(image % 3 < 2).withColumns({
        "pred_x": F.col("pred_x") - F.lit(1), "pred_y": F.col("pred_y") + F.lit(1),
        "pred_confidence": F.col("pred_confidence") + F.when(image % 3 == 0, F.lit(0.25)).otherwise(F.lit(0.0))})
    nowhere = F.lit(None).cast("double")
    pointless = p.where(image % 5 == 0).withColumns({"pred_x": nowhere, "pred_y": nowhere})
    return mt.core_metrics(fr.join_predictions(
        v.frames(spark, sf), p.unionByName(copies).unionByName(pointless), v.splits(spark, sf), v.tags(spark, sf),
        v.lines(spark, sf), "val", True))


@query("per_frame_table", """
SELECT image_id, dive_id, split, wavelength, line_confidence >= 5 AS steady, is_positive, pred_x, pred_y, pred_confidence, raw_err AS err FROM per_frame
""", ("per_frame",), "pred_x pred_y pred_confidence err")
def per_frame_table(spark, sf):
    return v.per_frame(spark, sf).withColumn("err", pixel_error()).select(
        "image_id", "dive_id", "split", "wavelength", (F.col("line_confidence") >= 5).alias("steady"),
        "is_positive", "pred_x", "pred_y", "pred_confidence", "err")


# Failure breakdown -----------------------------------------------------------------

SUMMARY = """count(*) AS n, count(*) FILTER (WHERE fail) AS n_fail, avg(CAST(NOT fail AS INTEGER)) AS hit_rate_n3,
  quantile_cont(err, 0.5) AS median_err, avg(err) AS mean_err,
  CAST(count(*) FILTER (WHERE fail) AS DOUBLE) / count(*) AS failure_rate,
  CAST(count(*) FILTER (WHERE fail) AS DOUBLE) / (SELECT greatest(count(*), 1) FROM enriched WHERE fail) AS share_of_failures"""
SUMMARY_DOUBLES = "hit_rate_n3 median_err mean_err failure_rate share_of_failures"


def _axes_sql() -> str:
    parts = []
    for name, columns in sr.AXES.items():
        stratum = " || '/' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in columns)
        parts.append(f"SELECT '{name}' AS axis, {stratum} AS stratum, {SUMMARY} FROM enriched GROUP BY {', '.join(columns)}")
    return " UNION ALL ".join(parts)


@query("failure_axes", _axes_sql(), ("enriched",), SUMMARY_DOUBLES)
def failure_axes(spark, sf):
    return sr.summarize_axes(v.enriched(spark, sf), sr.AXES)


@query("failures_by_rig_and_colour", f"SELECT rig_id, wavelength, {SUMMARY.replace('enriched', 'pos')} FROM pos GROUP BY rig_id, wavelength",
       ("pos",), SUMMARY_DOUBLES)
def failures_by_rig_and_colour(spark, sf):
    return sr.summarize_axis(v.positives(spark, sf), ["rig_id", "wavelength"])


@query("failure_flags", "SELECT image_id, no_pred, fail, err FROM pos", ("pos",), "err")
def failure_flags(spark, sf):
    return v.positives(spark, sf).select("image_id", "no_pred", "fail", "err")


@query("stratum_labels", """
SELECT image_id, line_q, prior_q, fail_class, err_class, dist_from_prior FROM enriched
""", ("enriched",), "dist_from_prior")
def stratum_labels(spark, sf):
    return v.enriched(spark, sf).select(
        "image_id", "line_q", "prior_q", "fail_class", "err_class", "dist_from_prior")


@query("per_dive_metrics", """
SELECT dive_id, count(*) AS n_positive, avg(raw_err) AS mean_err, quantile_cont(raw_err, 0.5) AS median_err,
  avg(CAST(raw_err <= 3 AS INTEGER)) AS hit_rate_n3, avg(CAST(raw_err <= 4 AS INTEGER)) AS hit_rate_n4,
  any_value(wavelength) AS wavelength, any_value(line_confidence) AS line_confidence FROM per_frame WHERE is_positive GROUP BY dive_id
""", ("per_frame",), "mean_err median_err hit_rate_n3 hit_rate_n4 line_confidence", 4)
def per_dive_metrics(spark, sf):
    return sr.per_dive_metrics(v.joined(spark, sf))


@query("worst_dives", """
SELECT dive_id, avg(raw_err) AS mean_err FROM per_frame WHERE is_positive GROUP BY dive_id
ORDER BY mean_err DESC NULLS FIRST, dive_id LIMIT 20
""", ("per_frame",), "mean_err")
def worst_dives(spark, sf):
    return sr.worst_first(sr.per_dive_metrics(v.joined(spark, sf))).limit(20).select("dive_id", "mean_err")


@query("colour_quartile_crosstab", """
SELECT wavelength, line_q, count(*) AS n, avg(CAST(raw_err <= 3 AS INTEGER)) AS hit_rate_n3, avg(raw_err) AS mean_err FROM (
  SELECT p.*, CASE WHEN line_confidence IS NULL THEN 'none' WHEN line_confidence <= e1 THEN 'q1' WHEN line_confidence <= e2 THEN 'q2'
    WHEN line_confidence <= e3 THEN 'q3' ELSE 'q4' END AS line_q
  FROM per_frame p, (SELECT quantile_cont(line_confidence, 0.25) AS e1, quantile_cont(line_confidence, 0.5) AS e2,
    quantile_cont(line_confidence, 0.75) AS e3 FROM per_frame)) WHERE is_positive GROUP BY wavelength, line_q
""", ("per_frame",), "hit_rate_n3 mean_err")
def colour_quartile_crosstab(spark, sf):
    return sr.colour_quartile_crosstab(v.joined(spark, sf))


@query("rig_priors", "SELECT rig_id, wavelength, n_prior, prior_x, prior_y FROM priors", ("priors",), "prior_x prior_y")
def rig_priors(spark, sf):
    return sr.rig_priors(v.positives(spark, sf))


PER_DIVE_FAIL = """
SELECT dive_id, any_value(wavelength) AS wavelength, count(*) AS n, count(*) FILTER (WHERE fail) AS n_fail,
  avg(err) FILTER (WHERE err < CAST('inf' AS DOUBLE)) AS mean_err,
  CAST(count(*) FILTER (WHERE fail) AS DOUBLE) / count(*) AS failure_rate FROM pos GROUP BY dive_id
"""


@query("per_dive_failures", PER_DIVE_FAIL, ("pos",), "mean_err failure_rate")
def per_dive_failures(spark, sf):
    return sr.per_dive_failures(v.positives(spark, sf))


@query("top_failing_dives", f"SELECT dive_id, n_fail FROM ({PER_DIVE_FAIL}) ORDER BY n_fail DESC, dive_id LIMIT 15", ("pos",))
def top_failing_dives(spark, sf):
    return sr.top_failing(sr.per_dive_failures(v.positives(spark, sf))).select("dive_id", "n_fail")


CUMULATIVE = f"""
SELECT row_number() OVER w AS dive_rank, dive_id, n_fail, CAST(sum(n_fail) OVER w AS BIGINT) AS cum_fail FROM ({PER_DIVE_FAIL})
WINDOW w AS (ORDER BY n_fail DESC, dive_id ROWS UNBOUNDED PRECEDING)
"""


@query("cumulative_failures", CUMULATIVE, ("pos",))
def cumulative_failures(spark, sf):
    return sr.cumulative_failures(sr.per_dive_failures(v.positives(spark, sf)))


@query("failure_concentration", f"""
SELECT dive_rank AS k, n_dives, cum_fail AS captured, total AS total_failures, CAST(cum_fail AS DOUBLE) / total AS share FROM (
  SELECT *, count(*) OVER () AS n_dives, CAST(sum(n_fail) OVER () AS BIGINT) AS total FROM ({CUMULATIVE}))
WHERE dive_rank IN (1, 5, 10, 20, 50) OR dive_rank = n_dives
""", ("pos",), "share")
def failure_concentration(spark, sf):
    return sr.concentration(sr.per_dive_failures(v.positives(spark, sf)))


HITS = "(SELECT *, pred_x - label_x AS dx, pred_y - label_y AS dy FROM pos WHERE NOT fail AND NOT no_pred)"


@query("residual_stats", f"""
SELECT count(*) AS n, avg(dx) AS mean_dx, avg(dy) AS mean_dy, stddev_pop(dx) AS std_dx, stddev_pop(dy) AS std_dy,
  quantile_cont(dx, 0.5) AS median_dx, quantile_cont(dy, 0.5) AS median_dy, quantile_cont(err, 0.25) AS err_p25,
  quantile_cont(err, 0.5) AS err_p50, quantile_cont(err, 0.75) AS err_p75, quantile_cont(err, 0.95) AS err_p95 FROM {HITS}
""", ("pos",), "mean_dx mean_dy std_dx std_dy median_dx median_dy err_p25 err_p50 err_p75 err_p95")
def residual_stats(spark, sf):
    return sr.residual_stats(v.positives(spark, sf))


@query("residual_bias", f"""
SELECT wavelength, count(*) AS n, avg(dx) AS mean_dx, avg(dy) AS mean_dy, stddev_pop(dx) AS std_dx, stddev_pop(dy) AS std_dy
FROM {HITS} GROUP BY wavelength
""", ("pos",), "mean_dx mean_dy std_dx std_dy")
def residual_bias(spark, sf):
    return sr.residual_bias(v.positives(spark, sf))


@query("failure_rates", """
SELECT wavelength, line_q, count(*) AS n, avg(CAST(fail AS INTEGER)) AS failure_rate FROM enriched GROUP BY wavelength, line_q
""", ("enriched",), "failure_rate")
def failure_rates(spark, sf):
    return sr.failure_rates(v.enriched(spark, sf))


@query("hit_error_histogram", """
SELECT least(CAST(floor(err / 3 * 30) AS BIGINT) + 1, 30) AS bin, count(*) AS n FROM pos WHERE err >= 0 AND err <= 3 GROUP BY 1
""", ("pos",))
def hit_error_histogram(spark, sf):
    return sr.linear_histogram(v.positives(spark, sf), "err", 0.0, 3.0, 30)


@query("log_error_histogram", """
SELECT wavelength, least(CAST(floor((log10(err) - log10(CAST(0.1 AS DOUBLE))) / (log10(top) - log10(CAST(0.1 AS DOUBLE))) * 39) AS BIGINT) + 1, 39) AS bin, count(*) AS n
FROM pos, (SELECT greatest(max(err), 10) AS top FROM pos WHERE err < CAST('inf' AS DOUBLE))
WHERE err >= CAST(0.1 AS DOUBLE) AND err <= top GROUP BY 1, 2
""", ("pos",))
def log_error_histogram(spark, sf):
    return sr.log_histogram(v.positives(spark, sf), "err", ["wavelength"])


# Statistics ---------------------------------------------------------------------------

@query("average_ranks", """
SELECT value, n, lowest + CAST(n - 1 AS DOUBLE) / 2 AS average_rank FROM (
  SELECT value, count(*) AS n, min(r) AS lowest FROM (SELECT value, rank() OVER (ORDER BY value) AS r FROM events) GROUP BY value)
""", (), "value average_rank")
def average_ranks(spark, sf):
    return st.average_ranks(v.table(spark, sf, "events"), [], "value")


GROUP_TEST = """
SELECT n_a, n_b, mean_a, mean_b, median_a, median_b, u AS u_stat,
  greatest(abs(u - na * nb / 2) - CAST(0.5 AS DOUBLE), 0) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS z,
  (mean_a - mean_b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS cohens_d, 1 - 2 * u / (na * nb) AS rank_biserial
FROM (
  SELECT count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE NOT a) AS n_b,
    CAST(count(*) FILTER (WHERE a) AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE NOT a) AS DOUBLE) AS nb,
    avg(val) FILTER (WHERE a) AS mean_a, avg(val) FILTER (WHERE NOT a) AS mean_b,
    quantile_cont(val, 0.5) FILTER (WHERE a) AS median_a, quantile_cont(val, 0.5) FILTER (WHERE NOT a) AS median_b,
    var_samp(val) FILTER (WHERE a) AS va, var_samp(val) FILTER (WHERE NOT a) AS vb,
    sum(r) FILTER (WHERE a) - CAST(count(*) FILTER (WHERE a) AS DOUBLE) * (count(*) FILTER (WHERE a) + 1) / 2 AS u,
    sum(CAST(t AS DOUBLE) * t - 1) AS ties
  FROM (SELECT *, rank() OVER (ORDER BY val) + CAST(t - 1 AS DOUBLE) / 2 AS r FROM (
    SELECT *, count(*) OVER (PARTITION BY val) AS t FROM ({source}))))
"""
TEST_DOUBLES = "mean_a mean_b median_a median_b u_stat z cohens_d rank_biserial"


@query("confidence_by_outcome", GROUP_TEST.replace("{source}", "SELECT fail AS a, pred_confidence AS val FROM pos"), ("pos",), TEST_DOUBLES)
def confidence_by_outcome(spark, sf):
    return st.compare_groups(v.positives(spark, sf), "pred_confidence", F.col("fail"))


# The same test per dimension of the embeddings.
DIMENSION_TEST = (
    GROUP_TEST.replace("SELECT n_a,", "SELECT dim, n_a,").replace("SELECT count(*) FILTER (WHERE a) AS n_a", "SELECT dim, count(*) FILTER (WHERE a) AS n_a")
    .replace("rank() OVER (ORDER BY val)", "rank() OVER (PARTITION BY dim ORDER BY val)").replace("PARTITION BY val", "PARTITION BY dim, val")
    .replace("FROM ({source}))))", "FROM ({source}))) GROUP BY dim)")
    .replace("{source}", "SELECT label < 5 AS a, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings"))


def _dimensions(spark, sf) -> DataFrame:
    e = v.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "val"))
    return st.compare_groups(
        e.withColumn("dim", F.col("dim").cast("long")), "val", F.col("label") < 5, ["dim"])


@query("embedding_by_label", DIMENSION_TEST, (), TEST_DOUBLES)
def embedding_by_label(spark, sf):
    return _dimensions(spark, sf)


# Normal tail by the midpoint rule over the bell between 0 and |z|.
_P_VALUE = """SELECT t.*, 1 - 2 / sqrt(pi()) * (SELECT sum(exp(-power(x * (range + 0.5) / 20000, 2)) * x / 20000)
    FROM range(20000), (SELECT abs(t.z) / sqrt(CAST(2 AS DOUBLE)) AS x)) AS p_value FROM ({test}) t"""


@query("confidence_test_p", _P_VALUE.replace("{test}", GROUP_TEST.replace(
    "{source}", "SELECT fail AS a, pred_confidence AS val FROM pos")), ("pos",), TEST_DOUBLES + " p_value")
def confidence_test_p(spark, sf):
    return st.with_p_value(st.compare_groups(v.positives(spark, sf), "pred_confidence", F.col("fail")))


@query("embedding_test_p", _P_VALUE.replace("{test}", DIMENSION_TEST), (), TEST_DOUBLES + " p_value")
def embedding_test_p(spark, sf):
    return st.with_p_value(_dimensions(spark, sf))


def _deltas(spark, sf) -> DataFrame:
    return st.paired_deltas(v.positives(spark, sf).filter(F.col("fail")), "pred_y", "label_y")


@query("paired_deltas", """
SELECT count(*) AS n, avg(d) AS mean_delta, avg(CAST(d > 0 AS INTEGER)) AS fraction_positive, quantile_cont(d, 0.5) AS median_delta
FROM (SELECT pred_y - label_y AS d FROM pos WHERE fail) WHERE d IS NOT NULL
""", ("pos",), "mean_delta fraction_positive median_delta")
def paired_deltas(spark, sf):
    return st.paired_summary(_deltas(spark, sf))


SIGNED_RANK = """
SELECT n, w AS w_stat, (w - nd * (nd + 1) / 4) / sqrt((nd * (nd + 1) * (2 * nd + 1) - ties / 2) / 24) AS z FROM (
  SELECT count(*) AS n, CAST(count(*) AS DOUBLE) AS nd, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)) AS w,
    sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM (
    SELECT *, rank() OVER (ORDER BY abs(d)) + CAST(t - 1 AS DOUBLE) / 2 AS r FROM (
      SELECT d, count(*) OVER (PARTITION BY abs(d)) AS t FROM (
        SELECT pred_y - label_y AS d FROM pos WHERE fail) WHERE d <> 0)))
"""


@query("signed_rank", SIGNED_RANK, ("pos",), "w_stat z")
def signed_rank(spark, sf):
    return st.signed_rank(_deltas(spark, sf))


@query("signed_rank_p", _P_VALUE.replace("{test}", SIGNED_RANK), ("pos",), "w_stat z p_value")
def signed_rank_p(spark, sf):
    return st.with_p_value(st.signed_rank(_deltas(spark, sf)))


# Calibration ----------------------------------------------------------------------------

FOUND = "(SELECT *, pred_x - label_x AS dx, pred_y - label_y AS dy FROM per_frame WHERE is_positive AND pred_x IS NOT NULL AND pred_y IS NOT NULL)"


@query("median_bias", f"""
SELECT split, count(*) AS n_inliers, quantile_cont(dx, 0.5) AS offset_x, quantile_cont(dy, 0.5) AS offset_y
FROM {FOUND} WHERE raw_err <= 5 GROUP BY split
""", ("per_frame",), "offset_x offset_y")
def median_bias(spark, sf):
    return cal.bias_offset(v.joined(spark, sf), ["split"], "median")


@query("mean_bias", f"SELECT count(*) AS n_inliers, avg(dx) AS offset_x, avg(dy) AS offset_y FROM {FOUND} WHERE raw_err <= 5",
       ("per_frame",), "offset_x offset_y")
def mean_bias(spark, sf):
    return cal.bias_offset(v.joined(spark, sf), [], "mean")


RATE = """avg(CAST(coalesce(raw_err <= 3, false) AS INTEGER)) AS hit_rate_raw,
  avg(CAST(coalesce(sqrt((pred_x - ox - label_x) * (pred_x - ox - label_x) + (pred_y - oy - label_y) * (pred_y - oy - label_y)) <= 3, false) AS INTEGER)) AS hit_rate_calibrated"""


@query("bias_transfer", f"""
SELECT split, count(*) AS n, {RATE} FROM per_frame,
  (SELECT quantile_cont(dx, 0.5) AS ox, quantile_cont(dy, 0.5) AS oy FROM {FOUND} WHERE raw_err <= 5 AND split = 'val')
WHERE is_positive AND split IN ('test', 'train') GROUP BY split
""", ("per_frame",), "hit_rate_raw hit_rate_calibrated")
def bias_transfer(spark, sf):
    return cal.transfer_bias(v.joined(spark, sf), "val", ["test", "train"])


def _loo_sql(fx: str, fy: str) -> str:
    return f"""
SELECT p.dive_id, o.ox AS offset_x, o.oy AS offset_y, count(*) AS n, {RATE} FROM per_frame p JOIN (
  SELECT d.dive_id, {fx} AS ox, {fy} AS oy FROM (SELECT DISTINCT dive_id FROM per_frame WHERE is_positive) d
  JOIN {FOUND} i ON i.dive_id <> d.dive_id AND i.raw_err <= 5 GROUP BY d.dive_id) o ON p.dive_id = o.dive_id
WHERE is_positive GROUP BY p.dive_id, o.ox, o.oy
"""


@query("leave_one_out_mean", _loo_sql("avg(dx)", "avg(dy)"), ("per_frame",), "offset_x offset_y hit_rate_raw hit_rate_calibrated")
def leave_one_out_mean(spark, sf):
    return cal.leave_one_out(v.joined(spark, sf), "mean")


@query("leave_one_out_median", _loo_sql("quantile_cont(dx, 0.5)", "quantile_cont(dy, 0.5)"), ("per_frame",),
       "offset_x offset_y hit_rate_raw hit_rate_calibrated")
def leave_one_out_median(spark, sf):
    return cal.leave_one_out(v.joined(spark, sf), "median")


@query("rolling_consensus", """
SELECT image_id, med_x, med_y, sqrt((pred_x - med_x) * (pred_x - med_x) + (pred_y - med_y) * (pred_y - med_y)) > 200 AS snapped FROM (
  SELECT image_id, pred_x, pred_y, quantile_cont(pred_x, 0.5) OVER w AS med_x, quantile_cont(pred_y, 0.5) OVER w AS med_y
  FROM per_frame WHERE pred_x IS NOT NULL WINDOW w AS (PARTITION BY dive_id ORDER BY image_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
""", ("per_frame",), "med_x med_y")
def rolling_consensus(spark, sf):
    # A short chunk makes the border handling part of the check.
    return cal.rolling_consensus(v.joined(spark, sf), 200.0, chunk=16).select(
        "image_id", "med_x", "med_y", "snapped")


def _with_line(spark, sf) -> DataFrame:
    normals = v.lines(spark, sf).select("dive_id", "line_a", "line_b", "line_c")
    return v.joined(spark, sf).join(normals, "dive_id", "left")


@query("residuals_by_line_direction", f"""
SELECT wavelength, count(*) AS n, avg(line_a * dy - line_b * dx) AS mean_along, avg(line_a * dx + line_b * dy) AS mean_across,
  stddev_pop(line_a * dy - line_b * dx) AS std_along, stddev_pop(line_a * dx + line_b * dy) AS std_across
FROM {FOUND} f JOIN (SELECT dive_id, line_a, line_b FROM lines WHERE line_a IS NOT NULL) l USING (dive_id) GROUP BY wavelength
""", ("per_frame", "lines"), "mean_along mean_across std_along std_across")
def residuals_by_line_direction(spark, sf):
    return cal.residual_split(_with_line(spark, sf), ["wavelength"])


@query("multi_click_spread", """
SELECT dive_id, image_id, count(*) AS n_clicks, var_pop(line_a * label_y - line_b * label_x) AS var_along,
  var_pop(line_a * label_x + line_b * label_y) AS var_across
FROM (SELECT dive_id, image_id, label_x, label_y FROM frames
      UNION ALL SELECT dive_id, image_id, label_x + 2, label_y - 1 FROM frames WHERE image_id % 9 = 0)
JOIN lines USING (dive_id) WHERE label_x IS NOT NULL AND line_a IS NOT NULL GROUP BY dive_id, image_id HAVING count(*) > 1
""", ("frames", "lines"), "var_along var_across", 4)
def multi_click_spread(spark, sf):
    f = v.frames(spark, sf).select(
        "dive_id", "image_id", F.col("label_x").alias("x"), F.col("label_y").alias("y"), "label_studio_task_id")
    clicks = f.unionByName(v.second_clicks(f)).select(
        "dive_id", "image_id", F.col("x").alias("label_x"), F.col("y").alias("label_y"))
    return cal.multi_click_spread(clicks.join(v.lines(spark, sf), "dive_id"))


@query("distractor_clusters", f"""
SELECT dive_id, cell_x, cell_y, n, mean_x, mean_y, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY dive_id ORDER BY n DESC, cell_x, cell_y) AS place FROM (
    SELECT dive_id, CAST(floor(pred_x / 64) AS BIGINT) AS cell_x, CAST(floor(pred_y / 64) AS BIGINT) AS cell_y, count(*) AS n,
      avg(pred_x) AS mean_x, avg(pred_y) AS mean_y FROM {FOUND} WHERE raw_err > 50 GROUP BY 1, 2, 3)) WHERE place <= 3
""", ("per_frame",), "mean_x mean_y")
def distractor_clusters(spark, sf):
    return cal.distractor_clusters(v.joined(spark, sf))


# Runs and gates ---------------------------------------------------------------------------

RUNS_SQL = """(SELECT *, sqrt((pred_x - label_x) * (pred_x - label_x) + (pred_y - label_y) * (pred_y - label_y)) AS e FROM (
  SELECT image_id, dive_id, is_positive, label_x, label_y, 'c' || c AS config, CASE WHEN c = 2 AND image_id % 10 = 0 THEN NULL ELSE pred_x + c END AS pred_x,
    pred_y - c * CAST(0.5 AS DOUBLE) AS pred_y FROM per_frame, (SELECT unnest([0, 1, 2]) AS c) WHERE is_positive))"""
RUN_TABLE = f"""
SELECT config, any_value(ox) AS offset_x, any_value(oy) AS offset_y, count(*) AS n,
  avg(CAST(coalesce(e <= 3, false) AS INTEGER)) AS hit_raw, avg(CAST(coalesce(m <= 3, false) AS INTEGER)) AS hit_calibrated,
  count(*) FILTER (WHERE m IS NULL OR m > 3) AS n_fail, count(*) FILTER (WHERE m > 3 AND m <= 10) AS n_borderline,
  count(*) FILTER (WHERE m > 10 AND m <= 50) AS n_mid, count(*) FILTER (WHERE m > 50) AS n_catastrophic
FROM (SELECT r.*, ox, oy, sqrt((pred_x - ox - label_x) * (pred_x - ox - label_x) + (pred_y - oy - label_y) * (pred_y - oy - label_y)) AS m
  FROM {RUNS_SQL} r JOIN (SELECT config, quantile_cont(pred_x - label_x, 0.5) AS ox, quantile_cont(pred_y - label_y, 0.5) AS oy
    FROM {RUNS_SQL} WHERE e <= 5 GROUP BY config) USING (config)) GROUP BY config
"""


def _runs(spark, sf) -> DataFrame:
    c = F.col("_c")
    lost = (c == 2) & (F.col("image_id") % 10 == 0)
    return v.joined(spark, sf).withColumn("_c", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn(
        "config", F.concat(F.lit("c"), c.cast("string"))).withColumn(
        "pred_x", F.when(~lost, F.col("pred_x") + c)).withColumn("pred_y", F.col("pred_y") - c * F.lit(0.5))


@query("run_table", RUN_TABLE, ("per_frame",), "offset_x offset_y hit_raw hit_calibrated")
def run_table(spark, sf):
    return cmp.run_table(_runs(spark, sf))


@query("runs_against_baseline", f"""
SELECT t.config, (t.hit_raw - b.hit_raw) * 100 AS delta_raw_pp, (t.hit_calibrated - b.hit_calibrated) * 100 AS delta_calibrated_pp,
  t.n_fail - b.n_fail AS delta_fail FROM ({RUN_TABLE}) t, (SELECT * FROM ({RUN_TABLE}) WHERE config = 'c0') b
""", ("per_frame",), "delta_raw_pp delta_calibrated_pp")
def runs_against_baseline(spark, sf):
    return cmp.against_baseline(cmp.run_table(_runs(spark, sf)), "c0")


@query("runs_side_by_side", """
SELECT config, avg(hit) FILTER (WHERE run = 'red') AS red, avg(hit) FILTER (WHERE run = 'green') AS green,
  avg(hit) FILTER (WHERE run = 'green') - avg(hit) FILTER (WHERE run = 'red') AS delta
FROM (SELECT 'rig' || rig_id AS config, wavelength AS run, CAST(NOT fail AS INTEGER) AS hit FROM pos WHERE wavelength IS NOT NULL) GROUP BY config
""", ("pos",), "red green delta")
def runs_side_by_side(spark, sf):
    table = v.positives(spark, sf).filter(F.col("wavelength").isNotNull()).groupBy(
        F.concat(F.lit("rig"), F.col("rig_id").cast("string")).alias("config"), F.col("wavelength").alias("run")
    ).agg(F.avg((~F.col("fail")).cast("double")).alias("hit_calibrated"))
    return cmp.side_by_side(table, ["red", "green"])


@query("outlying_dives", """
SELECT dive_id, h AS hit_rate_n3 FROM (SELECT dive_id, avg(CAST(raw_err <= 3 AS INTEGER)) AS h FROM per_frame WHERE is_positive GROUP BY dive_id) d,
  (SELECT quantile_cont(h, 0.5) AS med, stddev_pop(h) AS sd FROM (
    SELECT avg(CAST(raw_err <= 3 AS INTEGER)) AS h FROM per_frame WHERE is_positive GROUP BY dive_id)) WHERE h < med - 2 * sd
""", ("per_frame",), "hit_rate_n3")
def outlying_dives(spark, sf):
    return cmp.outlying_dives(sr.per_dive_metrics(v.joined(spark, sf))).select("dive_id", "hit_rate_n3")


@query("promotion_gate", """
SELECT hit_rate, fpr, worst_dive_hit_rate, hit_rate >= 0.95 AND fpr <= 0.02 AND worst_dive_hit_rate >= 0.8 AS promote FROM (
  SELECT avg(CAST(coalesce(raw_err <= 3, false) AS INTEGER)) FILTER (WHERE is_positive) AS hit_rate,
    avg(CAST(coalesce(pred_confidence, 0) >= 0.5 AS INTEGER)) FILTER (WHERE NOT is_positive) AS fpr FROM per_frame),
  (SELECT min(h) AS worst_dive_hit_rate FROM (
    SELECT avg(CAST(coalesce(raw_err <= 3, false) AS INTEGER)) AS h FROM per_frame WHERE is_positive GROUP BY dive_id))
""", ("per_frame",), "hit_rate fpr worst_dive_hit_rate")
def promotion_gate(spark, sf):
    return cmp.promotion_gate(v.joined(spark, sf))


ROC = """
SELECT conf AS threshold, CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER () AS tpr, CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER () AS fpr FROM (
  SELECT coalesce(pred_confidence, 0) AS conf, count(*) FILTER (WHERE is_positive) AS p, count(*) FILTER (WHERE NOT is_positive) AS n
  FROM per_frame GROUP BY 1) WINDOW w AS (ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)
"""


@query("roc_points", ROC, ("per_frame",), "threshold tpr fpr")
def roc_points(spark, sf):
    rows = v.joined(spark, sf).withColumn("_c", F.coalesce("pred_confidence", F.lit(0.0)))
    return mt.roc_points(rows, "_c", F.col("is_positive"))


@query("threshold_calibration", f"SELECT threshold, tpr, fpr FROM ({ROC}) WHERE fpr <= 0.02 ORDER BY threshold LIMIT 1", ("per_frame",), "threshold tpr fpr")
def threshold_calibration(spark, sf):
    return cmp.calibrate_threshold(v.joined(spark, sf))


@query("corridor_keep_rates", """
SELECT corridor_px, count(*) AS n, avg(CAST(line_a IS NULL OR abs(line_a * label_x + line_b * label_y + line_c) / sqrt(line_a * line_a + line_b * line_b) <= corridor_px AS INTEGER)) AS kept
FROM records, (SELECT unnest([CAST(5 AS DOUBLE), 13, 25, 50]) AS corridor_px) WHERE is_positive GROUP BY corridor_px
""", ("records",), "corridor_px kept")
def corridor_keep_rates(spark, sf):
    return cmp.corridor_keep_rate(fr.positives(v.records(spark, sf)), (5, 13, 25, 50))


@query("price_quantiles_by_priority", """
SELECT o_orderpriority, quantile_cont(o_totalprice, 0.05) AS p5, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.99) AS p99
FROM orders GROUP BY o_orderpriority
""", (), "p5 p50 p99")
def price_quantiles_by_priority(spark, sf):
    c = "o_totalprice"
    return exact_quantiles(v.table(spark, sf, "orders"), ["o_orderpriority"], {
        "p5": (c, 0.05), "p50": (c, 0.5), "p99": (c, 0.99)})
