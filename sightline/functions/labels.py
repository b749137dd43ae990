"""Row predicates and classes on labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sightline.functions.geometry import distance

INF = float("inf")

# Tolerances and class limits in pixels.
HIT_TOLERANCE_PX = 3.0
BORDERLINE_MAX_PX = 10.0
MID_MAX_PX = 50.0
LOW_CONFIDENCE_BELOW = 1.0


def is_positive(x: Column, y: Column, superseded: Column) -> Column:
    """Both coordinates present and not superseded (null counts as not)."""
    return x.isNotNull() & y.isNotNull() & ~F.coalesce(superseded, F.lit(False))


def pixel_error() -> Column:
    """Distance of prediction and label; null when either is missing."""
    return distance(F.col("pred_x"), F.col("pred_y"), F.col("label_x"), F.col("label_y"))


def no_prediction() -> Column:
    return F.col("pred_x").isNull() | F.col("pred_y").isNull()


def hit(err: Column, tolerance: float) -> Column:
    """Within tolerance; a missing error is a miss."""
    return F.coalesce(err <= F.lit(float(tolerance)), F.lit(False))


def error_or(err: Column, missing: str) -> Column:
    """Apply a policy for missing predictions.

    ``"inf"``: infinite error, so a failure.  ``"skip"`` and ``"miss"`` keep the
    null: the first leaves it out of every average, the second counts it as a
    miss through :func:`hit`.
    """
    if missing not in ("inf", "skip", "miss"):
        raise ValueError(f"missing must be inf, skip or miss, not {missing!r}")
    if missing == "inf":
        return F.when(no_prediction(), F.lit(INF)).otherwise(err)
    return err


def quartile_label(
    value: Column,
    q1: Column,
    q2: Column,
    q3: Column,
    names: tuple[str, str, str, str] = ("q1", "q2", "q3", "q4"),
    missing: str | None = "none",
) -> Column:
    """Name of the (lo, hi] bin; ``missing`` for null values."""
    return (
        F.when(value.isNull(), F.lit(missing))
        .when(value <= q1, F.lit(names[0]))
        .when(value <= q2, F.lit(names[1]))
        .when(value <= q3, F.lit(names[2]))
        .otherwise(F.lit(names[3]))
    )


PRIOR_DISTANCE_NAMES = ("near_q1", "q2", "q3", "far_q4")


def failure_class(fail: Column, no_pred: Column, confidence: Column) -> Column:
    """hit, presence_nopred, presence_lowconf or localization."""
    return (
        F.when(~fail, F.lit("hit"))
        .when(no_pred, F.lit("presence_nopred"))
        .when(confidence < F.lit(LOW_CONFIDENCE_BELOW), F.lit("presence_lowconf"))
        .otherwise(F.lit("localization"))
    )


def error_class(fail: Column, err: Column) -> Column:
    """hit, borderline_3to10, mid_10to50, catastrophic_gt50 or no_pred."""
    return (
        F.when(~fail, F.lit("hit"))
        .when(err <= F.lit(BORDERLINE_MAX_PX), F.lit("borderline_3to10"))
        .when(err <= F.lit(MID_MAX_PX), F.lit("mid_10to50"))
        .when(err < F.lit(INF), F.lit("catastrophic_gt50"))
        .otherwise(F.lit("no_pred"))
    )


def colour_value(tag: Column) -> Column:
    """Model input value of a colour tag: red 1, green 0, anything else 0.5."""
    return F.when(tag == "red", F.lit(1.0)).when(tag == "green", F.lit(0.0)).otherwise(F.lit(0.5))
