"""Declared schemas of the persisted tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _B, _S = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FRAMES = _schema(
    ("dive_id", _L), ("image_id", _L), ("rig_id", _L),
    ("image_path", _S), ("image_checksum", _S),
    ("label_x", _D), ("label_y", _D), ("is_positive", _B), ("label_string", _S),
    ("label_studio_task_id", _L), ("label_studio_project_id", _L),
    ("superseded", _B), ("completed", _B),
)
FRAMES_FLAGGED = T.StructType(FRAMES.fields + _schema(
    ("label_is_outlier", _B), ("perp_distance_to_line", _D)).fields)
LINES = _schema(
    ("dive_id", _L), ("n_positives", _L),
    ("line_a", _D), ("line_b", _D), ("line_c", _D),
    ("inlier_count", _L), ("inlier_fraction", _D),
    ("residual_std", _D), ("label_noise_mad", _D),
    ("line_confidence", _D), ("is_line_confident", _B),
)
WAVELENGTHS = _schema(
    ("dive_id", _L), ("wavelength", _S), ("wavelength_source", _S),
    ("dive_color_b", _D), ("dive_color_g", _D), ("dive_color_r", _D),
)
SPLITS = _schema(("dive_id", _L), ("split", _S))
AUDIT = _schema(
    ("dive_id", _L), ("image_id", _L), ("wavelength", _S),
    ("blob_diameter_px", _D), ("blob_pixels", _L),
)
PREDICTIONS = _schema(
    ("image_id", _L), ("pred_x", _D), ("pred_y", _D), ("pred_confidence", _D))
CANDIDATES = _schema(
    ("image_id", _L), ("tile_idx", _L), ("tile_x", _L), ("tile_y", _L),
    ("x", _L), ("y", _L), ("logit", _D), ("presence", _D),
)
PIXELS = _schema(
    ("image_id", _L), ("x", _L), ("y", _L), ("b", _L), ("g", _L), ("r", _L))
STORED = _schema(
    ("image_checksum", _S), ("height", T.IntegerType()), ("width", T.IntegerType()), ("n_channels", T.IntegerType()),
    ("data", T.BinaryType()))
MANIFEST = _schema(
    ("image_checksum", _S), ("image_path", _S), ("status", _S), ("height", T.IntegerType()), ("width", T.IntegerType()),
    ("n_channels", T.IntegerType()), ("run", _S))
ORF_FLIP = _schema(("image_checksum", _S), ("flip", T.IntegerType()))
RIG_INTRINSICS = _schema(
    ("rig_id", _L), ("fx", _D), ("fy", _D), ("cx", _D), ("cy", _D),
    ("dist", T.ArrayType(_D)),
)
METRICS = _schema(
    ("run_id", _S), ("step", _L), ("slice", _S), ("metric", _S), ("value", _D))
RUNS = _schema(("run_id", _S), ("key", _S), ("value", _S))
