"""Building the item table and joining group facts and predictions onto it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.geometry import inverse_rotation
from sightline.functions.labels import is_positive
from sightline.operators.ordering import salted_join


def choose_dives(
    dives: DataFrame, canonical_only: bool = True, max_dives: int | None = None
) -> DataFrame:
    """Dives to ingest: canonical ones, at most ``max_dives`` in id order."""
    chosen = dives.filter(F.col("is_canonical")) if canonical_only else dives
    if max_dives is not None:
        chosen = chosen.orderBy("dive_id").limit(max_dives)
    return chosen


def split_failed(sources: DataFrame, failures: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Sources without a recorded failure, and a one-row count of both kinds."""
    failed = failures.select(key).distinct()
    good = sources.join(failed, key, "left_anti")
    counts = sources.join(failed.withColumn("_failed", F.lit(True)), key, "left").agg(
        F.count_if(F.col("_failed").isNull()).alias("n_ok"),
        F.count_if(F.col("_failed")).alias("n_failed"),
    )
    return good, counts


def latest_images(images: DataFrame, order: str) -> DataFrame:
    """One row per (dive, image): the last one by ``order`` wins, then the largest path."""
    keep = [c for c in ("image_path", "image_checksum") if c in images.columns]
    body = F.struct(*keep)
    chosen = F.max_by(body, F.struct(F.col(order).alias("order"), body.alias("body")))
    return (
        images.filter(F.col("image_id").isNotNull())
        .groupBy("dive_id", "image_id").agg(chosen.alias("_image"))
        .select("dive_id", "image_id", *[F.col(f"_image.{c}").alias(c) for c in keep])
    )


def build_frames(
    dives: DataFrame, images: DataFrame, labels: DataFrame, image_order: str
) -> DataFrame:
    """One row per label that has an image in its own dive.

    Labels and images meet on (dive_id, image_id), a key no single dive can
    make hot; the dive facts come in through the smaller image side.
    """
    rigs = dives.filter(F.col("dive_id").isNotNull()).select("dive_id", F.col("camera_id").alias("rig_id"))
    located = latest_images(images, image_order).join(rigs, "dive_id")
    joined = labels.filter(F.col("image_id").isNotNull()).join(located, ["dive_id", "image_id"])
    return joined.select(
        "dive_id", "image_id", "rig_id", "image_path", "image_checksum",
        F.col("x").cast("double").alias("label_x"),
        F.col("y").cast("double").alias("label_y"),
        is_positive(F.col("x"), F.col("y"), F.col("superseded")).alias("is_positive"),
        F.col("label").alias("label_string"),
        "label_studio_task_id", "label_studio_project_id", "superseded", "completed",
    )


def frame_counters(frames: DataFrame) -> DataFrame:
    """Rows, positives, distinct dives and rigs."""
    return frames.agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(F.col("is_positive")).alias("n_positive"),
        F.count_distinct("dive_id").alias("n_dives"),
        F.count_distinct("rig_id").alias("n_rigs"),
    )


def distinct_rigs(frames: DataFrame) -> DataFrame:
    return frames.select("rig_id").dropna().distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def drop_superseded(frames: DataFrame) -> DataFrame:
    """Keep rows known not to be superseded; no-op without that column."""
    if "superseded" not in frames.columns:
        return frames
    return frames.filter(~F.col("superseded"))


def positives(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("is_positive"))


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(members.select(key).distinct(), key, "left_semi")


def partition_by_presence(records: DataFrame, available: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records whose key is available, and a one-row count of kept and dropped."""
    known = available.select(key).distinct()
    kept = records.join(known, key, "left_semi")
    counts = records.join(known.withColumn("_kept", F.lit(True)), key, "left").agg(
        F.count_if(F.col("_kept")).alias("n_kept"),
        F.count_if(F.col("_kept").isNull()).alias("n_dropped"),
    )
    return kept, counts


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct on a subset: the row smallest by ``order``, merged map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    body = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min(body).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]])


def dive_context(
    wavelengths: DataFrame | None = None,
    lines: DataFrame | None = None,
    splits: DataFrame | None = None,
    split: str | None = None,
) -> DataFrame:
    """All group facts in one row per dive, so that frames are joined once.

    Colour and line are optional facts; a given split restricts the dives.
    """
    context = None
    if splits is not None:
        context = splits.filter(F.col("split") == split) if split else splits
    for table, columns in (
        (wavelengths, ["wavelength"]),
        (lines, ["line_a", "line_b", "line_c", "line_confidence", "is_line_confident"]),
    ):
        if table is None:
            continue
        facts = table.select("dive_id", *[c for c in columns if c in table.columns])
        if context is None:
            context = facts
        elif splits is not None:
            context = context.join(facts, "dive_id", "left")
        else:
            context = context.join(facts, "dive_id", "full")
    if context is None:
        raise ValueError("at least one group table is needed")
    return context


def classical_context(wavelengths: DataFrame, lines: DataFrame) -> DataFrame:
    """Per-dive colour and line for the classical detector; no line is not confident."""
    facts = lines.select("dive_id", "line_a", "line_b", "line_c", "is_line_confident")
    return wavelengths.select("dive_id", "wavelength").join(facts, "dive_id", "left").withColumn(
        "is_line_confident", F.coalesce("is_line_confident", F.lit(False)))


def unique_predictions(predictions: DataFrame) -> DataFrame:
    """One prediction per image: the most confident, then the smallest point."""
    order = F.struct(
        F.col("pred_confidence"), (-F.col("pred_x")).alias("x"), (-F.col("pred_y")).alias("y"))
    body = F.struct("pred_x", "pred_y", "pred_confidence")
    return predictions.groupBy("image_id").agg(F.max_by(body, order).alias("_p")).select(
        "image_id", "_p.pred_x", "_p.pred_y", "_p.pred_confidence")


def join_predictions(
    frames: DataFrame,
    predictions: DataFrame,
    splits: DataFrame,
    wavelengths: DataFrame,
    lines: DataFrame,
    split: str | None = "val",
    dedupe_predictions: bool = False,
) -> DataFrame:
    """Frames of a split with colour, line confidence and prediction.

    k labels and k predictions of one image give k*k rows unless
    ``dedupe_predictions`` is set.  The dive facts are joined in one go; the
    predictions meet on image_id, which spreads a hot dive evenly.
    """
    context = dive_context(
        wavelengths, lines.select("dive_id", "line_confidence"), splits, split)
    pred = unique_predictions(predictions) if dedupe_predictions else predictions
    return salted_join(frames, context, ["dive_id"], ["image_id"]).join(
        pred.select("image_id", "pred_x", "pred_y", "pred_confidence"), "image_id", "left")


def build_records(
    frames: DataFrame,
    wavelengths: DataFrame,
    lines: DataFrame | None = None,
    orf_flip: DataFrame | None = None,
    drop_superseded_rows: bool = True,
    sensor_h: int = 3016,
    sensor_w: int = 4014,
) -> DataFrame:
    """Training records: frames with colour, line facts and sensor-space label.

    Only positives keep a label point; line fields default to 0 and false.
    """
    base = drop_superseded(frames) if drop_superseded_rows else frames
    context = wavelengths.select("dive_id", "wavelength")
    if lines is not None:
        context = dive_context(wavelengths, lines)
    joined = salted_join(base, context, ["dive_id"], ["image_id"], "left")
    flip: Column = F.lit(None).cast("int")
    if orf_flip is not None:
        joined = joined.join(orf_flip.select("image_checksum", "flip"), "image_checksum", "left")
        flip = F.col("flip")
    point = F.when(
        F.col("is_positive"),
        inverse_rotation(F.col("label_x"), F.col("label_y"), flip, sensor_h, sensor_w))
    out = joined.withColumn("_point", point)
    if lines is not None:
        has_line = F.col("line_a").isNotNull()
        line = [
            F.col("line_a"), F.col("line_b"), F.col("line_c"),
            F.when(has_line, F.coalesce("line_confidence", F.lit(0.0))).otherwise(F.lit(0.0))
            .alias("line_confidence"),
            (has_line & F.coalesce("is_line_confident", F.lit(False))).alias("is_line_confident"),
        ]
    else:
        line = [F.lit(None).cast("double").alias(c) for c in ("line_a", "line_b", "line_c")]
        line += [F.lit(0.0).alias("line_confidence"), F.lit(False).alias("is_line_confident")]
    return out.select(
        "dive_id", "image_id", "rig_id", "image_path", "image_checksum",
        F.col("_point.x").alias("label_x"), F.col("_point.y").alias("label_y"),
        "wavelength", *line)


def split_records(
    frames: DataFrame,
    splits: DataFrame,
    split: str,
    wavelengths: DataFrame,
    lines: DataFrame | None = None,
    orf_flip: DataFrame | None = None,
    max_dives: int | None = None,
) -> DataFrame:
    """Records of one split, optionally of its first ``max_dives`` dives only."""
    dives = splits.filter(F.col("split") == split).select("dive_id")
    if max_dives is not None:
        dives = dives.orderBy("dive_id").limit(max_dives)
    return build_records(keep_members(frames, dives, "dive_id"), wavelengths, lines, orf_flip)
