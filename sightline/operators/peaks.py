"""From candidate peaks per tile to one post-processed prediction per image.

CANDIDATES holds one row per kept heatmap cell: image, tile, local cell (x, y),
its logit and the tile's presence score.  All merges are aggregates by image,
so nothing depends on how the scorer partitioned its output.  An exploded table is
larger than Catalyst thinks, so candidates are never offered for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions.geometry import (
    RigPrior, clamp, corridor_weight, parabola_shift, rig_prior_weight, soft_snap)
from sightline.operators.tiles import TILE


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def line_gate(records: DataFrame, use_line: bool = True) -> DataFrame:
    """Line parameters as inference sees them: only if asked for and confident.

    Corridor and snap share this gate.  ``records`` may hold an image several times
    (one row per label); its dive, and so its line, is the same.
    """
    usable = F.lit(use_line) & F.coalesce("is_line_confident", F.lit(False)) & F.col("line_a").isNotNull()
    return records.select(
        "image_id", "width", "height",
        *[F.when(usable, F.col(c)).alias(c) for c in ("line_a", "line_b", "line_c")],
        F.when(usable, F.col("line_confidence")).otherwise(F.lit(0.0)).alias("line_confidence"),
    ).dropDuplicates(["image_id"])


def masked_value(prior: RigPrior | None, corridor_px: float | None) -> Column:
    """Heatmap probability times the priors at the candidate's frame position."""
    x, y = F.col("tile_x") + F.col("x"), F.col("tile_y") + F.col("y")
    value = sigmoid(F.col("logit"))
    if prior is not None:
        value = value * rig_prior_weight(x, y, prior)
    if corridor_px is not None:
        weight = corridor_weight(
            x, y, F.col("line_a"), F.col("line_b"), F.col("line_c"), corridor_px)
        value = value * F.when(F.col("line_confidence") > 0, weight).otherwise(F.lit(1.0))
    return value


def best_peaks(
    candidates: DataFrame,
    gate: DataFrame,
    prior: RigPrior | None = None,
    corridor_px: float | None = None,
) -> DataFrame:
    """Winning cell per image: highest value, then lowest tile, row and column."""
    scored = candidates.hint("merge").join(gate, "image_id").withColumn("value", masked_value(prior, corridor_px))
    order = F.struct(
        "value", (-F.col("tile_idx")).alias("t"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    best = scored.groupBy("image_id").agg(
        F.max_by(F.struct("tile_idx", "tile_x", "tile_y", "x", "y", "logit", "value"), order).alias("p"),
        F.max("presence").alias("presence"))
    return best.select("image_id", "p.*", "presence")


def refine_subpixel(best: DataFrame, candidates: DataFrame, tile: int = TILE) -> DataFrame:
    """Add (shift_x, shift_y) of the parabola through the logits next to the peak.

    The four neighbours come by an equi-join on the cell, which a kept
    neighbour matches at most once; edge peaks and missing neighbours stay put.
    """
    steps = F.array(*[
        F.struct(F.lit(n).alias("side"), F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"))
        for n, dx, dy in (("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("d", 0, 1))])
    wanted = best.select(
        "image_id", "tile_idx", "x", "y", F.explode(steps).alias("s")
    ).select(
        "image_id", "tile_idx", F.col("s.side").alias("side"),
        (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    around = wanted.join(
        candidates.select("image_id", "tile_idx", "x", "y", F.col("logit").alias("v")).hint("merge"),
        ["image_id", "tile_idx", "x", "y"]
    ).groupBy("image_id").agg(*[
        F.max(F.when(F.col("side") == s, F.col("v"))).alias(f"_{s}") for s in "lrud"])
    edge = (
        (F.col("x") <= 0) | (F.col("x") >= tile - 1) | (F.col("y") <= 0) | (F.col("y") >= tile - 1))
    # All four neighbours are needed for either axis.
    whole = ~edge & F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_u").isNotNull() & F.col("_d").isNotNull()

    def shift(before: str, after: str) -> Column:
        return F.when(whole, parabola_shift(F.col(before), F.col("logit"), F.col(after))).otherwise(F.lit(0.0))

    return (
        best.join(around, "image_id", "left")
        .withColumn("shift_x", shift("_l", "_r"))
        .withColumn("shift_y", shift("_u", "_d"))
        .drop("_l", "_r", "_u", "_d")
    )


def _snapped(df: DataFrame, tau: float, alpha_max: float) -> DataFrame:
    """Snap (px, py) toward the gated line and clamp to the image."""
    snap = soft_snap(
        F.col("px"), F.col("py"), F.col("line_a"), F.col("line_b"), F.col("line_c"),
        F.col("line_confidence"), F.col("conf"), tau, alpha_max)
    use = F.col("line_a").isNotNull() & (F.col("line_confidence") > 0)
    return (
        df.withColumn("_snap", F.when(use, snap))
        .withColumn("px", F.when(use, clamp(F.col("_snap.x"), 0.0, F.col("width") - 1.0)).otherwise(F.col("px")))
        .withColumn("py", F.when(use, clamp(F.col("_snap.y"), 0.0, F.col("height") - 1.0)).otherwise(F.col("py")))
        .withColumn("alpha", F.when(use, F.col("_snap.alpha")).otherwise(F.lit(0.0)))
        .drop("_snap")
    )


def merge_tiles(
    candidates: DataFrame,
    gate: DataFrame,
    prior: RigPrior | None = None,
    corridor_px: float | None = None,
    subpixel: bool = False,
    presence_threshold: float | None = None,
    tau: float = 5.0,
    alpha_max: float = 0.3,
    tile: int = TILE,
) -> DataFrame:
    """PREDICTIONS from candidates: best peak, optional refinement, clamp and snap.

    Below ``presence_threshold`` the point is null; the confidence stays.
    """
    best = best_peaks(candidates, gate, prior, corridor_px)
    if subpixel:
        best = refine_subpixel(best, candidates, tile)
    else:
        best = best.withColumn("shift_x", F.lit(0.0)).withColumn("shift_y", F.lit(0.0))
    placed = (
        best.join(gate, "image_id")
        .withColumn("conf", F.greatest("presence", F.lit(0.0)))
        .withColumn("px", F.least(F.col("tile_x") + F.col("x") + F.col("shift_x"), F.col("width") - 1.0))
        .withColumn("py", F.least(F.col("tile_y") + F.col("y") + F.col("shift_y"), F.col("height") - 1.0))
    )
    snapped = _snapped(placed, tau, alpha_max)
    shown = F.lit(True) if presence_threshold is None else F.col("conf") >= presence_threshold
    return snapped.select(
        "image_id",
        F.when(shown, F.col("px")).alias("pred_x"), F.when(shown, F.col("py")).alias("pred_y"),
        F.col("conf").alias("pred_confidence"),
        F.when(shown, F.col("value")).alias("peak_value"))


def refine_window(coarse: DataFrame, window: int = TILE) -> DataFrame:
    """Crop origin of the second pass around each coarse point, inside the image."""
    half = window // 2

    def origin(at: str, size: str) -> Column:
        low = F.greatest(F.lit(0).cast("long"), F.rint(at).cast("long") - F.lit(half))
        high = F.least(F.col(size).cast("long"), low + F.lit(window))
        return F.greatest(F.lit(0).cast("long"), high - F.lit(window))

    return coarse.filter(F.col("pred_x").isNotNull() & F.col("pred_y").isNotNull()).select(
        "image_id", origin("pred_x", "width").alias("tile_x"), origin("pred_y", "height").alias("tile_y"))


def resolve_two_pass(
    coarse: DataFrame,
    refined: DataFrame,
    gate: DataFrame,
    presence_threshold: float | None = None,
    tau: float = 5.0,
    alpha_max: float = 0.3,
) -> DataFrame:
    """Take the refined point unless it is too weak; snap and clamp only then.

    ``refined`` has (image_id, ref_x, ref_y, ref_value, ref_presence).  It falls
    back to the coarse result when its presence is below the threshold or its
    heatmap value below half the coarse presence.  An image without a coarse
    point keeps the coarse row.
    """
    both = coarse.join(refined, "image_id", "left").join(gate, "image_id")
    weak = F.col("ref_value") < F.lit(0.5) * F.col("pred_confidence")
    if presence_threshold is not None:
        weak = weak | (F.col("ref_presence") < presence_threshold)
    fell_back = F.col("pred_x").isNull() | F.col("ref_x").isNull() | weak
    staged = (
        both.withColumn("fell_back", fell_back)
        .withColumn("px", clamp(F.col("ref_x"), 0.0, F.col("width") - 1.0))
        .withColumn("py", clamp(F.col("ref_y"), 0.0, F.col("height") - 1.0))
        .withColumn("conf", F.greatest("pred_confidence", "ref_presence"))
    )
    snapped = _snapped(staged, tau, alpha_max)

    def pick(old: str, new: str) -> Column:
        return F.when(F.col("fell_back"), F.col(old)).otherwise(F.col(new)).alias(old)

    return snapped.select(
        "image_id", pick("pred_x", "px"), pick("pred_y", "py"), pick("pred_confidence", "conf"), "fell_back")


def remove_bias(predictions: DataFrame, dx: Column | float, dy: Column | float) -> DataFrame:
    """Subtract a calibrated offset and clamp; needs (width, height)."""
    ox = dx if isinstance(dx, Column) else F.lit(float(dx))
    oy = dy if isinstance(dy, Column) else F.lit(float(dy))
    return predictions.withColumn(
        "pred_x", clamp(F.col("pred_x") - ox, 0.0, F.col("width") - 1.0)
    ).withColumn("pred_y", clamp(F.col("pred_y") - oy, 0.0, F.col("height") - 1.0))


def rectify_points(
    predictions: DataFrame, intrinsics: DataFrame | None, steps: int = 5, clamp_to_image: bool = True
) -> DataFrame:
    """Undo radial and tangential lens distortion per rig (k1 k2 p1 p2 k3 k4 k5 k6).

    Fixed-point iteration from the normalised point.  It is a fold over the step
    numbers: a filter on the result may inline the expression, and unrolled
    steps would then multiply.  Points of a rig without intrinsics and null
    points are left alone; with no table at all nothing happens.
    """
    if intrinsics is None:
        return predictions
    joined = predictions.join(intrinsics, "rig_id", "left")
    k1, k2, p1, p2, k3, k4, k5, k6 = (
        F.coalesce(F.get("dist", F.lit(i)), F.lit(0.0)) for i in range(8))
    x0 = (F.col("pred_x") - F.col("cx")) / F.col("fx")
    y0 = (F.col("pred_y") - F.col("cy")) / F.col("fy")
    two = F.lit(2.0)

    def step(at: Column, _: Column) -> Column:
        x, y = at["x"], at["y"]
        r2 = x * x + y * y
        inverse = (F.lit(1.0) + ((k6 * r2 + k5) * r2 + k4) * r2) / (
            F.lit(1.0) + ((k3 * r2 + k2) * r2 + k1) * r2)
        shift_x = two * p1 * x * y + p2 * (r2 + two * x * x)
        shift_y = p1 * (r2 + two * y * y) + two * p2 * x * y
        return F.struct(((x0 - shift_x) * inverse).alias("x"), ((y0 - shift_y) * inverse).alias("y"))

    start = F.struct(x0.alias("x"), y0.alias("y"))
    solved = joined.withColumn("_p", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
    new_x = F.col("_p.x") * F.col("fx") + F.col("cx")
    new_y = F.col("_p.y") * F.col("fy") + F.col("cy")
    if clamp_to_image:
        new_x = clamp(new_x, 0.0, F.col("width") - 1.0)
        new_y = clamp(new_y, 0.0, F.col("height") - 1.0)
    known = F.col("fx").isNotNull() & F.col("pred_x").isNotNull()
    out = solved.withColumns({
        "pred_x": F.when(known, new_x).otherwise(F.col("pred_x")),
        "pred_y": F.when(known, new_y).otherwise(F.col("pred_y")),
    })
    return out.select(*predictions.columns)


def soft_argmax(candidates: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Softmax-weighted mean position per (image, tile) in frame coordinates.

    Logits are shifted by their maximum before the exponential.  The maximum comes from a window over the
    cells of one tile, in the exchange that the sums use; cells without image or tile have no row.
    """
    keys = ["image_id", "tile_idx"]
    peak = F.max("logit").over(Window.partitionBy(*keys))
    weight = F.exp((F.col("logit") - F.col("_peak")) / F.lit(float(temperature)))
    return (
        candidates.dropna(subset=keys)
        .withColumn("_peak", peak)
        .withColumn("_w", weight)
        .groupBy(*keys)
        .agg(
            (F.sum(F.col("_w") * (F.col("tile_x") + F.col("x"))) / F.sum("_w")).alias("soft_x"),
            (F.sum(F.col("_w") * (F.col("tile_y") + F.col("y"))) / F.sum("_w")).alias("soft_y"))
    )


def line_consistency(points: DataFrame) -> DataFrame:
    """Confidence-weighted mean distance to the dive line, over one row.

    Needs (soft_x, soft_y, line_a, line_b, line_c, line_confidence, valid); the
    weight sum is at least one and no valid row gives zero.
    """
    w = F.greatest(
        F.when(F.col("valid"), F.col("line_confidence")).otherwise(F.lit(0.0)), F.lit(0.0))
    d = F.abs(
        F.col("line_a") * F.col("soft_x") + F.col("line_b") * F.col("soft_y") + F.col("line_c"))
    weighted = F.sum(F.when(w > 0, d * w))
    return points.agg(
        F.coalesce(weighted / F.greatest(F.sum(w), F.lit(1.0)), F.lit(0.0)).alias("line_loss"),
        F.count_if(F.col("valid")).alias("n_valid"))

