"""From scored tiles to evaluated predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sightline.functions.geometry import RigPrior
from sightline.operators.metrics import evaluate
from sightline.operators.peaks import (
    line_gate, merge_tiles, rectify_points, remove_bias, resolve_two_pass)
from sightline.operators.raster import classical_predictions


@dataclass(frozen=True)
class Recipe:
    """Post-processing switches, named as in :func:`merge_tiles`."""

    prior: RigPrior | None = None
    corridor_px: float | None = None
    subpixel: bool = False
    snap: bool = False
    alpha_max: float = 0.3
    tau: float = 5.0
    bias_x: float = 0.0
    bias_y: float = 0.0
    presence_threshold: float | None = None


def postprocess(
    candidates: DataFrame,
    records: DataFrame,
    recipe: Recipe = Recipe(),
    refined: DataFrame | None = None,
    intrinsics: DataFrame | None = None,
) -> DataFrame:
    """PREDICTIONS: merge, optional second pass, snap, then bias, then rectification.

    ``records`` has (image_id, rig_id, width, height) and line facts.  Records
    without candidates (image not loadable) get a null point and confidence 0.
    """
    gate = line_gate(records, recipe.snap)
    first_alpha = 0.0 if refined is not None else recipe.alpha_max
    merged = merge_tiles(
        candidates, gate, recipe.prior, recipe.corridor_px, recipe.subpixel,
        recipe.presence_threshold, recipe.tau, first_alpha)
    if refined is not None:
        merged = resolve_two_pass(
            merged, refined, gate, recipe.presence_threshold, recipe.tau, recipe.alpha_max)
    sized = merged.select("image_id", "pred_x", "pred_y", "pred_confidence").join(
        records.select("image_id", "rig_id", "width", "height"), "image_id", "right")
    if recipe.bias_x or recipe.bias_y:
        sized = remove_bias(sized, recipe.bias_x, recipe.bias_y)
    final = rectify_points(sized, intrinsics)
    return final.fillna(0.0, ["pred_confidence"]).select(
        "image_id", "pred_x", "pred_y", "pred_confidence")


def evaluate_candidates(
    candidates: DataFrame, records: DataFrame, frames: DataFrame, splits: DataFrame,
    wavelengths: DataFrame, lines: DataFrame, recipe: Recipe = Recipe(), split: str = "val",
    **kwargs: DataFrame,
) -> DataFrame:
    """Post-process and evaluate one split in a single plan."""
    predictions = postprocess(candidates, records, recipe, **kwargs)
    return evaluate(predictions, frames, splits, wavelengths, lines, split)


def evaluate_classical(
    frames: DataFrame, pixels: DataFrame, splits: DataFrame, wavelengths: DataFrame,
    lines: DataFrame, split: str = "val",
) -> DataFrame:
    """Classical detector on one split's frames, then the same evaluation."""
    chosen = frames.join(splits.filter(splits["split"] == split).select("dive_id"), "dive_id", "left_semi")
    predictions = classical_predictions(chosen, pixels, wavelengths, lines)
    return evaluate(predictions, frames, splits, wavelengths, lines, split)
