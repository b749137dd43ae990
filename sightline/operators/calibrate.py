"""Bias calibration and residual geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sightline.functions.geometry import distance
from sightline.functions.labels import hit, pixel_error
from sightline.operators.frames import positives
from sightline.operators.ordering import (
    counted_cells, salted_join, value_ranked, values_at_ranks, with_constants, with_medians)
from sightline.operators.strata import with_residual

INLIER_ERR_PX = 5.0


def localized(per_frame: DataFrame) -> DataFrame:
    """Predicted positives with ``err``, ``dx`` and ``dy``."""
    found = positives(per_frame).filter(F.col("pred_x").isNotNull() & F.col("pred_y").isNotNull())
    return with_residual(found.withColumn("err", pixel_error()))


def bias_offset(
    per_frame: DataFrame,
    keys: Sequence[str] = (),
    estimator: str = "median",
    max_err: float = INLIER_ERR_PX,
) -> DataFrame:
    """Signed residual offset (offset_x, offset_y) of the inliers per group."""
    if estimator not in ("median", "mean"):
        raise ValueError("estimator must be median or mean")
    keys = list(keys)
    inliers = localized(per_frame).filter(F.col("err") <= F.lit(float(max_err)))
    counts = inliers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_inliers"), F.avg("dx").alias("offset_x"), F.avg("dy").alias("offset_y"))
    if estimator == "mean":
        return counts
    return with_medians(
        counts.drop("offset_x", "offset_y"), inliers, keys, {"offset_x": "dx", "offset_y": "dy"})


def _hit_rates(df: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    raw = pixel_error()
    moved = distance(
        F.col("pred_x") - F.col("offset_x"), F.col("pred_y") - F.col("offset_y"),
        F.col("label_x"), F.col("label_y"))
    return positives(df).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit(raw, tolerance).cast("double")).alias("hit_rate_raw"),
        F.avg(hit(moved, tolerance).cast("double")).alias("hit_rate_calibrated"))


def transfer_bias(
    per_frame: DataFrame, derive_on: str, apply_to: Sequence[str], estimator: str = "median",
    tolerance: float = 3.0,
) -> DataFrame:
    """Derive the offset on one split and compare hit rates on others."""
    offset = bias_offset(per_frame.filter(F.col("split") == derive_on), [], estimator).select(
        "offset_x", "offset_y")
    target = with_constants(per_frame.filter(F.col("split").isin(*apply_to)), offset)
    return _hit_rates(target, ["split"], tolerance)


def _offsets_of_others_mean(inliers: DataFrame) -> DataFrame:
    """Mean residual of all other dives: the grand total less the dive's own sum."""
    own = inliers.groupBy("dive_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("dx").alias("_sx"), F.sum("dy").alias("_sy"))
    grand = own.agg(F.sum("_n").alias("_all_n"), F.sum("_sx").alias("_all_x"), F.sum("_sy").alias("_all_y"))
    others = F.col("_all_n") - F.col("_n")
    return with_constants(own, grand).select(
        "dive_id",
        F.when(others > 0, (F.col("_all_x") - F.col("_sx")) / others).alias("offset_x"),
        F.when(others > 0, (F.col("_all_y") - F.col("_sy")) / others).alias("offset_y"))


def _median_of_others(inliers: DataFrame, component: str, out: str) -> DataFrame:
    """Exact median of ``component`` over all rows outside each dive.

    Let a dive's values be placed last among equal pooled values.  The r-th
    value of the others sits at pooled rank r plus the number of own values with
    at most r others before them, so each dive only needs its own value cells,
    their pooled ranks and one lookup; no dive meets the rows of another.
    """
    pooled = counted_cells(inliers, [], component)
    own = counted_cells(inliers, ["dive_id"], component).select(
        "dive_id", "_v", F.col("c").alias("o"), F.col("start").alias("own_start"), F.col("total").alias("m"))
    others_before = F.col("start") + F.col("c") - F.col("own_start") - F.col("o")
    middle = (F.col("total") - F.col("m") - 1).cast("double") / 2
    low, high = F.floor(middle), F.ceil(middle)
    queries = (
        own.join(pooled, "_v")
        .groupBy("dive_id", "total", "m")
        .agg(
            F.sum(F.when(others_before <= low, F.col("o")).otherwise(F.lit(0))).alias("_jl"),
            F.sum(F.when(others_before <= high, F.col("o")).otherwise(F.lit(0))).alias("_jh"))
        .filter(F.col("total") > F.col("m"))
        .select("dive_id", F.explode(F.array(low + F.col("_jl"), high + F.col("_jh"))).alias("_rank"))
    )
    return values_at_ranks(queries, "_rank", pooled, "_value").groupBy("dive_id").agg(
        F.avg("_value").alias(out))


def leave_one_out(
    per_frame: DataFrame, estimator: str = "mean", tolerance: float = 3.0,
    max_err: float = INLIER_ERR_PX,
) -> DataFrame:
    """Per dive: the offset derived from all other dives, and its hit rate on this dive."""
    if estimator not in ("median", "mean"):
        raise ValueError("estimator must be median or mean")
    inliers = localized(per_frame).filter(F.col("err") <= F.lit(float(max_err)))
    if estimator == "mean":
        offsets = _offsets_of_others_mean(inliers)
    else:
        offsets = _median_of_others(inliers, "dx", "offset_x").join(
            _median_of_others(inliers, "dy", "offset_y"), "dive_id")
    joined = salted_join(positives(per_frame), offsets, ["dive_id"], ["image_id"], how="left")
    # A dive without inliers of its own is left out by the pooled offset itself.
    pooled = bias_offset(per_frame, [], estimator, max_err).select(
        F.col("offset_x").alias("_all_x"), F.col("offset_y").alias("_all_y"))
    known = inliers.select("dive_id").distinct().withColumn("_own", F.lit(True))
    filled = with_constants(joined.join(known, "dive_id", "left"), pooled)
    for axis in "xy":
        filled = filled.withColumn(f"offset_{axis}", F.when(
            F.col("_own"), F.col(f"offset_{axis}")).otherwise(F.col(f"_all_{axis}")))
    return _hit_rates(filled, ["dive_id", "offset_x", "offset_y"], tolerance)


def along_across(df: DataFrame) -> DataFrame:
    """Residual split by the dive line: ``d_along`` (tangent) and ``d_across`` (normal)."""
    return df.withColumn(
        "d_across", F.col("line_a") * F.col("dx") + F.col("line_b") * F.col("dy")
    ).withColumn("d_along", F.col("line_a") * F.col("dy") - F.col("line_b") * F.col("dx"))


def residual_split(per_frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of along-line and across-line residuals."""
    parts = along_across(localized(per_frame).filter(F.col("line_a").isNotNull()))
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("d_along").alias("mean_along"), F.avg("d_across").alias("mean_across"),
        F.stddev_pop("d_along").alias("std_along"), F.stddev_pop("d_across").alias("std_across"))


def multi_click_spread(labels: DataFrame) -> DataFrame:
    """Per image with several clicks: variance along and across the dive line."""
    along = F.col("line_a") * F.col("label_y") - F.col("line_b") * F.col("label_x")
    across = F.col("line_a") * F.col("label_x") + F.col("line_b") * F.col("label_y")
    usable = labels.filter(
        F.col("label_x").isNotNull() & F.col("label_y").isNotNull() & F.col("line_a").isNotNull())
    return usable.groupBy("dive_id", "image_id").agg(
        F.count(F.lit(1)).alias("n_clicks"),
        F.var_pop(along).alias("var_along"), F.var_pop(across).alias("var_across"),
    ).filter(F.col("n_clicks") > 1)


def rolling_consensus(
    df: DataFrame, threshold_px: float, half_window: int = 2, chunk: int = 100_000
) -> DataFrame:
    """Replace a prediction farther than ``threshold_px`` from its rolling median.

    The window is 2 * half_window + 1 predicted rows in image order of a dive.
    A dive is cut into chunks of consecutive positions; rows next to a border
    are also sent to the neighbour chunk, so every window is complete and no
    dive has to fit one task.
    """
    found = df.filter(F.col("pred_x").isNotNull() & F.col("pred_y").isNotNull())
    ranked = value_ranked(found, ["dive_id"], "image_id", ["pred_x", "pred_y"], "_r")
    home = F.floor(F.col("_r") / F.lit(chunk)).cast("long")
    inner = F.pmod(F.col("_r"), F.lit(chunk))
    places = F.array_compact(F.array(
        home,
        F.when((inner < half_window) & (home > 0), home - 1),
        F.when(inner >= chunk - half_window, home + 1)))
    spread = ranked.withColumn("_home", home).withColumn("_chunk", F.explode(places))
    w = Window.partitionBy("dive_id", "_chunk").orderBy("_r").rowsBetween(-half_window, half_window)
    moved = distance(F.col("pred_x"), F.col("pred_y"), F.col("med_x"), F.col("med_y")) > threshold_px
    return (
        spread.withColumn("med_x", F.percentile("pred_x", F.lit(0.5)).over(w))
        .withColumn("med_y", F.percentile("pred_y", F.lit(0.5)).over(w))
        .filter(F.col("_chunk") == F.col("_home"))
        .withColumn("snapped", moved)
        .withColumn("new_x", F.when(F.col("snapped"), F.col("med_x")).otherwise(F.col("pred_x")))
        .withColumn("new_y", F.when(F.col("snapped"), F.col("med_y")).otherwise(F.col("pred_y")))
        .drop("_r", "_home", "_chunk")
    )


def distractor_clusters(
    per_frame: DataFrame, cell_px: int = 64, min_err: float = 50.0, top: int = 3
) -> DataFrame:
    """Most frequent grid cells of catastrophic predictions per dive."""
    wrong = localized(per_frame).filter(F.col("err") > F.lit(float(min_err)))
    cells = wrong.groupBy(
        "dive_id",
        F.floor(F.col("pred_x") / F.lit(float(cell_px))).cast("long").alias("cell_x"),
        F.floor(F.col("pred_y") / F.lit(float(cell_px))).cast("long").alias("cell_y"),
    ).agg(F.count(F.lit(1)).alias("n"), F.avg("pred_x").alias("mean_x"), F.avg("pred_y").alias("mean_y"))
    order = Window.partitionBy("dive_id").orderBy(F.col("n").desc(), "cell_x", "cell_y")
    # Cells per dive are bounded by the raster size, and the limit is pushed below the exchange.
    return cells.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
