"""Hit rates, pixel errors and presence scores, overall and per slice.

Slices are produced by repeating a row under each slice name it belongs to and
grouping once: the grouping keys are few, partial sums leave every task as a
handful of rows, and medians and AUROC go through bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.labels import hit, pixel_error, quartile_label
from sightline.operators.frames import join_predictions
from sightline.operators.ordering import (
    attach_scalars, class_counts_at_or_above, exact_medians, exact_quantiles, join_null_safe,
    rank_sums, with_constants)
from sightline.session import cut_lineage

TOLERANCES_PX = (3, 4)
MIN_FOR_QUARTILES = 4


def quartile_edges(df: DataFrame, value: str, prefix: str = "edge") -> DataFrame:
    """One row with the three exact quartiles and the count of known values.

    The population is the frame given; callers choose it explicitly.
    """
    edges = exact_quantiles(df, [], {f"{prefix}{i}": (value, i / 4) for i in (1, 2, 3)})
    # An aggregate over no rows still has a row, so the scalars are never absent.
    counted = df.agg(F.count(value).alias(f"{prefix}_n"))
    return attach_scalars(counted, edges)


def with_quartile(
    df: DataFrame, population: DataFrame, value: str, out: str,
    names: tuple[str, str, str, str] = ("q1", "q2", "q3", "q4"), missing: str | None = "none",
    minimum: int = 0,
) -> DataFrame:
    """Label each row with the (lo, hi] quartile bin of ``population``.

    With fewer than ``minimum`` known values there are no bins: all null.  The
    three edges are read by one job.
    """
    both = with_constants(df, quartile_edges(population, value, "_edge"))
    label = quartile_label(F.col(value), F.col("_edge1"), F.col("_edge2"), F.col("_edge3"), names, missing)
    if minimum:
        label = F.when(F.col("_edge_n") >= minimum, label)
    return both.withColumn(out, label).drop("_edge1", "_edge2", "_edge3", "_edge_n")


def auroc(df: DataFrame, keys: Sequence[str], score: str, is_positive: Column) -> DataFrame:
    """Tie-aware area under the ROC curve per group; null with one class only."""
    sums = rank_sums(df, keys, score, is_positive)
    p, n = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    u = F.col("rank_sum") - p * (p + 1) / 2
    return sums.select(*keys, F.when((p > 0) & (n > 0), u / (p * n)).alias("presence_auroc"))


def scored_rows(per_frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns metrics need: ``is_positive``, ``_conf`` (null is 0) and ``_err``.

    ``_err`` is null for negatives and for positives without a prediction.
    """
    return per_frame.select(
        *keep, "is_positive",
        F.coalesce("pred_confidence", F.lit(0.0)).alias("_conf"),
        F.when(F.col("is_positive"), pixel_error()).alias("_err"))


def metrics_of_rows(
    rows: DataFrame, keys: Sequence[str], presence_threshold: float, tolerances_px: Sequence[float]
) -> DataFrame:
    """Metrics of :func:`scored_rows` per group: sums, medians and AUROC side by side."""
    pos, err = F.col("is_positive"), F.col("_err")
    called = (F.col("_conf") >= presence_threshold).cast("double")
    summary = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(pos).alias("n_positive"),
        F.count_if(~pos).alias("n_negative"),
        F.avg(F.when(~pos, called)).alias("fpr_at_threshold"),
        F.avg(F.when(pos, called)).alias("recall_at_threshold"),
        *[F.avg(F.when(pos, hit(err, t).cast("double"))).alias(f"hit_rate_n{t:g}") for t in tolerances_px],
        F.avg(F.when(pos, err.isNotNull().cast("double"))).alias("fraction_localized"),
        F.avg(err).alias("mean_pixel_error"),
    )
    medians = exact_medians(rows, keys, {"median_pixel_error": "_err"})
    areas = auroc(rows, keys, "_conf", pos)
    if not keys:
        return attach_scalars(attach_scalars(summary, medians), areas)
    return join_null_safe(join_null_safe(summary, medians, keys), areas, keys)


def core_metrics(
    per_frame: DataFrame,
    keys: Sequence[str] = (),
    presence_threshold: float = 0.5,
    tolerances_px: Sequence[float] = TOLERANCES_PX,
) -> DataFrame:
    """One row per group with all metrics; those without their class are null.

    A missing prediction on a positive is a miss but has no pixel error; a
    missing confidence is zero.  The rows are read three times (sums, errors,
    scores): materialise an expensive join first, as :func:`evaluate` does.
    """
    keys = list(keys)
    return metrics_of_rows(scored_rows(per_frame, keys), keys, presence_threshold, tolerances_px)


def as_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value) without absent metrics."""
    names = [c for c in wide.columns if c not in keys]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(
        *keys, "_p.metric", "_p.value").filter(F.col("value").isNotNull())


def slice_names(wavelength: Column, quartile: Column) -> Column:
    """Slices of a row: overall, its colour, its line quartile; nulls give none."""
    return F.array_compact(F.array(
        F.lit("overall"),
        F.concat(F.lit("wavelength_"), wavelength),
        F.concat(F.lit("line_"), quartile)))


def evaluate_joined(
    per_frame: DataFrame,
    presence_threshold: float = 0.5,
    tolerances_px: Sequence[float] = TOLERANCES_PX,
) -> DataFrame:
    """Metrics of joined frames as (slice, metric, value).

    Line quartiles are taken over all joined frames and need four known values.
    The five columns the metrics use are written to the checkpoint folder once,
    so the joins behind them run once and not per metric (runs two jobs).  Without
    any frame the result is the one row overall, n_frames, 0.
    """
    rows = cut_lineage(scored_rows(per_frame, ["wavelength", "line_confidence"]))
    binned = with_quartile(
        rows, rows, "line_confidence", "_q", missing=None, minimum=MIN_FOR_QUARTILES)
    sliced = binned.select(
        F.explode(slice_names(F.col("wavelength"), F.col("_q"))).alias("slice"),
        "is_positive", "_conf", "_err")
    nothing = rows.agg(F.count(F.lit(1)).alias("value")).filter("value = 0").select(
        F.lit("overall").alias("slice"), F.lit("n_frames").alias("metric"), F.col("value").cast("double").alias("value"))
    return as_long(
        metrics_of_rows(sliced, ["slice"], presence_threshold, tolerances_px), ["slice"]).unionByName(nothing)


def evaluate(
    predictions: DataFrame,
    frames: DataFrame,
    splits: DataFrame,
    wavelengths: DataFrame,
    lines: DataFrame,
    split: str = "val",
    presence_threshold: float = 0.5,
    tolerances_px: Sequence[float] = TOLERANCES_PX,
    dedupe_predictions: bool = False,
) -> DataFrame:
    """Evaluate predictions on one split: (slice, metric, value)."""
    per_frame = join_predictions(
        frames, predictions, splits, wavelengths, lines, split, dedupe_predictions)
    return evaluate_joined(per_frame, presence_threshold, tolerances_px)


def roc_points(df: DataFrame, score: str, is_positive: Column) -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score, predicting at or above it."""
    return class_counts_at_or_above(df, score, is_positive).select(
        F.col("_v").alias("threshold"),
        F.when(F.col("total_first") > 0, F.col("at_first") / F.col("total_first")).alias("tpr"),
        F.when(F.col("total_second") > 0, F.col("at_second") / F.col("total_second")).alias("fpr"))
