"""Comparing runs and configurations, and release gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from sightline.functions.geometry import RigPrior, corridor_weight, distance, rig_prior_weight
from sightline.functions.labels import BORDERLINE_MAX_PX, INF, MID_MAX_PX, error_or, hit, pixel_error
from sightline.operators.calibrate import bias_offset
from sightline.operators.frames import positives
from sightline.operators.metrics import TOLERANCES_PX, metrics_of_rows, roc_points, scored_rows
from sightline.operators.ordering import attach_scalars, exact_quantiles, join_null_safe, with_constants
from sightline.operators.peaks import sigmoid
from sightline.session import cut_lineage


def run_table(per_frame: DataFrame, estimator: str = "median", tolerance: float = 3.0) -> DataFrame:
    """Ablation matrix: one row per ``config`` with raw and calibrated outcomes.

    Each configuration is calibrated with its own inlier offset.  Failures are
    split into borderline, mid and catastrophic; no prediction is a failure.
    """
    offsets = bias_offset(per_frame, ["config"], estimator).select("config", "offset_x", "offset_y")
    rows = join_null_safe(positives(per_frame), offsets, ["config"])
    raw = error_or(pixel_error(), "inf")
    moved = distance(
        F.col("pred_x") - F.coalesce("offset_x", F.lit(0.0)),
        F.col("pred_y") - F.coalesce("offset_y", F.lit(0.0)), F.col("label_x"), F.col("label_y"))
    err = F.coalesce(moved, F.lit(INF))
    return rows.withColumn("_raw", raw).withColumn("_err", err).groupBy("config").agg(
        F.first("offset_x").alias("offset_x"), F.first("offset_y").alias("offset_y"),
        F.count(F.lit(1)).alias("n"),
        F.avg(hit(F.col("_raw"), tolerance).cast("double")).alias("hit_raw"),
        F.avg(hit(F.col("_err"), tolerance).cast("double")).alias("hit_calibrated"),
        F.count_if(F.col("_err") > tolerance).alias("n_fail"),
        F.count_if((F.col("_err") > tolerance) & (F.col("_err") <= BORDERLINE_MAX_PX)).alias("n_borderline"),
        F.count_if((F.col("_err") > BORDERLINE_MAX_PX) & (F.col("_err") <= MID_MAX_PX)).alias("n_mid"),
        F.count_if((F.col("_err") > MID_MAX_PX) & (F.col("_err") < INF)).alias("n_catastrophic"),
    )


def against_baseline(table: DataFrame, baseline: str) -> DataFrame:
    """Differences to one configuration, rates in percentage points."""
    base = table.filter(F.col("config") == baseline).agg(
        F.max("hit_raw").alias("_raw"), F.max("hit_calibrated").alias("_cal"), F.max("n_fail").alias("_fail"))
    return attach_scalars(table, base).select(
        "config",
        ((F.col("hit_raw") - F.col("_raw")) * 100).alias("delta_raw_pp"),
        ((F.col("hit_calibrated") - F.col("_cal")) * 100).alias("delta_calibrated_pp"),
        (F.col("n_fail") - F.col("_fail")).alias("delta_fail"))


def side_by_side(table: DataFrame, runs: Sequence[str], value: str = "hit_calibrated") -> DataFrame:
    """Pivot of ``value``: one row per config, one column per named run, and the difference."""
    wide = table.groupBy("config").pivot("run", list(runs)).agg(F.first(value))
    return wide.withColumn("delta", F.col(runs[-1]) - F.col(runs[0]))


def prior_sweep(
    candidates: DataFrame,
    frames: DataFrame,
    configs: Sequence[Mapping[str, float | str]],
    base: RigPrior = RigPrior(),
    presence_threshold: float = 0.5,
) -> DataFrame:
    """Metrics per prior setting (label, floor, sigma_x, sigma_y).

    One aggregate by image keeps the peak of every setting side by side; the
    settings, a short list, become rows only after that.
    """
    x, y = F.col("tile_x") + F.col("x"), F.col("tile_y") + F.col("y")
    keys = ["label", "floor", "sigma_x", "sigma_y"]
    point = F.struct(x.cast("double").alias("pred_x"), y.cast("double").alias("pred_y"))
    peaks, rows = [], []
    for i, c in enumerate(configs):
        prior = replace(
            base, floor=float(c["floor"]), sigma_x=float(c["sigma_x"]), sigma_y=float(c["sigma_y"]))
        value = sigmoid(F.col("logit")) * rig_prior_weight(x, y, prior)
        order = F.struct(
            value.alias("value"), (-F.col("tile_idx")).alias("t"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
        peaks.append(F.max_by(point, order).alias(f"_p{i}"))
        rows.append(F.struct(
            F.lit(str(c["label"])).alias("label"), F.lit(prior.floor).alias("floor"),
            F.lit(prior.sigma_x).alias("sigma_x"), F.lit(prior.sigma_y).alias("sigma_y"),
            F.col(f"_p{i}.pred_x").alias("pred_x"), F.col(f"_p{i}.pred_y").alias("pred_y")))
    best = candidates.groupBy("image_id").agg(*peaks, F.max("presence").alias("pred_confidence"))
    scored = best.select("image_id", "pred_confidence", F.explode(F.array(*rows)).alias("_c")).select(
        "image_id", "pred_confidence", "_c.*")
    joined = frames.select("image_id", "is_positive", "label_x", "label_y").join(scored, "image_id")
    # Three metric passes read the peaks; the scoring scan runs once.
    rows = cut_lineage(scored_rows(joined, keys))
    wide = metrics_of_rows(rows, keys, presence_threshold, TOLERANCES_PX)
    return wide.select(
        *keys, "hit_rate_n3", "hit_rate_n4", "presence_auroc", "fpr_at_threshold",
        "mean_pixel_error", "median_pixel_error")


def corridor_keep_rate(points: DataFrame, widths: Sequence[float]) -> DataFrame:
    """Share of labelled points that a corridor of each width would keep."""
    rows = points.withColumn("corridor_px", F.explode(F.array(*[F.lit(float(w)) for w in widths])))
    keep = corridor_weight(
        F.col("label_x"), F.col("label_y"), F.col("line_a"), F.col("line_b"), F.col("line_c"),
        F.col("corridor_px"))
    return rows.groupBy("corridor_px").agg(
        F.count(F.lit(1)).alias("n"), F.avg(keep).alias("kept"))


def outlying_dives(per_dive: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Dives whose hit rate is more than ``sigmas`` deviations below the median."""
    stats = per_dive.agg(F.stddev_pop("hit_rate_n3").alias("_sd"))
    middle = exact_quantiles(per_dive, [], {"_median": ("hit_rate_n3", 0.5)})
    return (
        with_constants(per_dive, attach_scalars(stats, middle))
        .filter(F.col("hit_rate_n3") < F.col("_median") - F.lit(float(sigmas)) * F.col("_sd"))
        .drop("_sd", "_median")
    )


def promotion_gate(
    per_frame: DataFrame, min_hit: float = 0.95, max_fpr: float = 0.02, min_dive_hit: float = 0.80,
    presence_threshold: float = 0.5, tolerance: float = 3.0,
) -> DataFrame:
    """One row: overall hit rate, FPR, worst dive, and whether all limits hold."""
    pos = F.col("is_positive")
    overall = per_frame.agg(
        F.avg(F.when(pos, hit(pixel_error(), tolerance).cast("double"))).alias("hit_rate"),
        F.avg(F.when(~pos, (F.coalesce("pred_confidence", F.lit(0.0)) >= presence_threshold).cast("double")))
        .alias("fpr"))
    worst = positives(per_frame).groupBy("dive_id").agg(
        F.avg(hit(pixel_error(), tolerance).cast("double")).alias("_h")
    ).agg(F.min("_h").alias("worst_dive_hit_rate"))
    return attach_scalars(overall, worst).withColumn(
        "promote",
        (F.coalesce("hit_rate", F.lit(0.0)) >= min_hit)
        & (F.coalesce("fpr", F.lit(0.0)) <= max_fpr)
        & (F.coalesce("worst_dive_hit_rate", F.lit(0.0)) >= min_dive_hit))


def calibrate_threshold(per_frame: DataFrame, max_fpr: float = 0.02) -> DataFrame:
    """Lowest confidence threshold whose false positive rate is within the target."""
    rows = per_frame.withColumn("_conf", F.coalesce("pred_confidence", F.lit(0.0)))
    points = roc_points(rows, "_conf", F.col("is_positive"))
    return points.filter(F.col("fpr") <= max_fpr).agg(
        F.min("threshold").alias("threshold"),
        F.min_by("tpr", "threshold").alias("tpr"), F.min_by("fpr", "threshold").alias("fpr"))
