"""Peak merging, geometry of predictions, and pixel-table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions import geometry as geo
from sightline.functions import pixels as px
from sightline.functions.labels import colour_value
from sightline.operators import compare as cmp
from sightline.operators import peaks as pk
from sightline.operators import raster as ra
from sightline.operators import sampling as sm
from sightline.operators import tags as tg
from workload import views as v
from workload.registry import query

PRIOR = geo.RigPrior()


def prior_sql(x: str, y: str, floor: str = "0.5", sx: str = "300", sy: str = "300") -> str:
    return f"""(CASE WHEN {x} >= 1100 AND {x} < 2950 AND {y} >= 700 AND {y} < 2180 THEN greatest(
      exp(CAST(-0.5 AS DOUBLE) * ((CAST({x} AS DOUBLE) - 1977) / {sx} * ((CAST({x} AS DOUBLE) - 1977) / {sx}) + (CAST({y} AS DOUBLE) - 1343) / {sy} * ((CAST({y} AS DOUBLE) - 1343) / {sy}))),
      CAST({floor} AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END)"""


# Geometry of single points -------------------------------------------------------------

@query("rig_prior_weights", f"SELECT image_id, {prior_sql('label_x', 'label_y')} AS weight, ln(greatest({prior_sql('label_x', 'label_y')}, 1e-4)) AS log_weight FROM frames WHERE is_positive",
       ("frames",), "weight log_weight")
def rig_prior_weights(spark, sf):
    f = v.frames(spark, sf).filter(F.col("is_positive"))
    return f.select(
        "image_id", geo.rig_prior_weight(F.col("label_x"), F.col("label_y"), PRIOR).alias("weight"),
        geo.rig_prior_log(F.col("label_x"), F.col("label_y"), PRIOR).alias("log_weight"))


LINE_JOIN = "(SELECT f.*, p.pred_x, p.pred_y, p.pred_confidence FROM records f JOIN predictions p USING (image_id))"


def _lined(spark, sf) -> DataFrame:
    return v.records(spark, sf).join(v.predictions(spark, sf), "image_id")


def _abc():
    return F.col("line_a"), F.col("line_b"), F.col("line_c")


@query("line_projection", f"""
SELECT image_id, pred_x - t * line_a AS foot_x, pred_y - t * line_b AS foot_y FROM (
  SELECT *, (line_a * pred_x + line_b * pred_y + line_c) / (line_a * line_a + line_b * line_b) AS t FROM {LINE_JOIN})
""", ("records", "predictions"), "foot_x foot_y", 5)
def line_projection(spark, sf):
    foot = geo.project_onto_line(F.col("pred_x"), F.col("pred_y"), *_abc())
    return _lined(spark, sf).withColumn("_f", foot).select(
        "image_id", F.col("_f.x").alias("foot_x"), F.col("_f.y").alias("foot_y"))


@query("soft_snap", f"""
SELECT image_id, (1 - alpha) * pred_x + alpha * (pred_x - t * line_a) AS snap_x, (1 - alpha) * pred_y + alpha * (pred_y - t * line_b) AS snap_y, alpha FROM (
  SELECT *, (line_a * pred_x + line_b * pred_y + line_c) / (line_a * line_a + line_b * line_b) AS t,
    greatest(CAST(0 AS DOUBLE), least(1 / (1 + exp(-(least(line_confidence, 600) - 5))) * (1 - pred_confidence), CAST(0.3 AS DOUBLE))) AS alpha
  FROM {LINE_JOIN}) WHERE line_a IS NOT NULL AND pred_x IS NOT NULL
""", ("records", "predictions"), "snap_x snap_y alpha", 5)
def soft_snap(spark, sf):
    snap = geo.soft_snap(F.col("pred_x"), F.col("pred_y"), *_abc(), F.col("line_confidence"), F.col("pred_confidence"))
    rows = _lined(spark, sf).filter(F.col("line_a").isNotNull() & F.col("pred_x").isNotNull())
    return rows.withColumn("_s", snap).select(
        "image_id", F.col("_s.x").alias("snap_x"), F.col("_s.y").alias("snap_y"), F.col("_s.alpha").alias("alpha"))


@query("corridor_flags", """
SELECT image_id, CASE WHEN line_a IS NULL THEN 1.0 WHEN abs(line_a * label_x + line_b * label_y + line_c) / sqrt(line_a * line_a + line_b * line_b) <= 25 THEN 1.0 ELSE 0.0 END AS inside
FROM records WHERE is_positive
""", ("records",), "inside")
def corridor_flags(spark, sf):
    r = v.records(spark, sf).filter(F.col("is_positive"))
    return r.select("image_id", geo.corridor_weight(F.col("label_x"), F.col("label_y"), *_abc(), 25.0).alias("inside"))


@query("sensor_labels", """
SELECT image_id, flip, CASE flip WHEN 3 THEN 4013 - label_x WHEN 5 THEN 4013 - label_y WHEN 6 THEN label_y ELSE label_x END AS sensor_x,
  CASE flip WHEN 3 THEN 3015 - label_y WHEN 5 THEN label_x WHEN 6 THEN 3015 - label_x ELSE label_y END AS sensor_y
FROM frames JOIN flips USING (image_checksum)
""", ("frames", "flips"), "sensor_x sensor_y")
def sensor_labels(spark, sf):
    rows = v.frames(spark, sf).join(v.flips(spark, sf), "image_checksum")
    point = geo.inverse_rotation(F.col("label_x"), F.col("label_y"), F.col("flip"), v.HEIGHT, v.WIDTH)
    return rows.withColumn("_p", point).select(
        "image_id", "flip", F.col("_p.x").alias("sensor_x"), F.col("_p.y").alias("sensor_y"))


@query("rotated_pixels", """
SELECT image_id, CAST(sum(g * CASE image_id % 4 WHEN 1 THEN w - 1 - x WHEN 2 THEN y WHEN 3 THEN h - 1 - y ELSE x END) AS BIGINT) AS moment_x,
  CAST(sum(g * CASE image_id % 4 WHEN 1 THEN h - 1 - y WHEN 2 THEN w - 1 - x WHEN 3 THEN x ELSE y END) AS BIGINT) AS moment_y
FROM pixels JOIN rasters USING (image_id) GROUP BY image_id
""", ("pixels",))
def rotated_pixels(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 3, 5, 6)]), (F.col("image_id") % 4 + 1).cast("int"))
    width, height = v.raster_size(F.col("image_id"))
    point = geo.forward_rotation(F.col("x"), F.col("y"), code, height, width)
    return v.pixels(spark, sf).withColumn("_p", point).groupBy("image_id").agg(
        F.sum(F.col("g") * F.col("_p.x")).alias("moment_x"), F.sum(F.col("g") * F.col("_p.y")).alias("moment_y"))


@query("bias_removed", """
SELECT image_id, CASE WHEN pred_x IS NOT NULL THEN greatest(0, least(pred_x - CAST(-0.2 AS DOUBLE), 4013)) END AS pred_x,
  CASE WHEN pred_y IS NOT NULL THEN greatest(0, least(pred_y - CAST(1900 AS DOUBLE), 3015)) END AS pred_y FROM predictions
""", ("predictions",), "pred_x pred_y")
def bias_removed(spark, sf):
    sized = v.predictions(spark, sf).withColumn("width", F.lit(v.WIDTH)).withColumn("height", F.lit(v.HEIGHT))
    return pk.remove_bias(sized, -0.2, 1900.0).select("image_id", "pred_x", "pred_y")


def _rectify_sql(steps: int = 5) -> str:
    rigs = ", ".join(
        f"({r}, CAST({3000 + 10 * r} AS DOUBLE), CAST({3010 + 10 * r} AS DOUBLE), CAST({2007 + r} AS DOUBLE), CAST({1508 - r} AS DOUBLE), "
        f"CAST({-0.02 + 0.001 * r!r} AS DOUBLE), CAST({0.0 if r == 2 else 0.0005} AS DOUBLE))" for r in range(6))
    inner = f"""SELECT p.image_id, p.pred_x, p.pred_y, fx, fy, cx, cy, k1, k3, (pred_x - cx) / fx AS x0, (pred_y - cy) / fy AS y0,
      (pred_x - cx) / fx AS x, (pred_y - cy) / fy AS y
      FROM predictions p JOIN frames f USING (image_id) LEFT JOIN (VALUES {rigs}) k(rig_id, fx, fy, cx, cy, k1, k3) USING (rig_id)"""
    for _ in range(steps):
        inner = f"""SELECT * REPLACE ((x0 - (2 * CAST(0.0002 AS DOUBLE) * x * y + CAST(-0.0001 AS DOUBLE) * (r2 + 2 * x * x))) / (1 + ((k3 * r2 + CAST(0.004 AS DOUBLE)) * r2 + k1) * r2) AS x,
          (y0 - (CAST(0.0002 AS DOUBLE) * (r2 + 2 * y * y) + 2 * CAST(-0.0001 AS DOUBLE) * x * y)) / (1 + ((k3 * r2 + CAST(0.004 AS DOUBLE)) * r2 + k1) * r2) AS y) FROM (
          SELECT *, x * x + y * y AS r2 FROM (SELECT * EXCLUDE (r2) FROM (SELECT *, 0 AS r2 FROM ({inner}))))"""
        inner = f"SELECT * EXCLUDE (r2) FROM ({inner})"
    return f"""SELECT image_id, CASE WHEN fx IS NULL OR pred_x IS NULL THEN pred_x ELSE greatest(0, least(x * fx + cx, 4013)) END AS pred_x,
      CASE WHEN fx IS NULL OR pred_x IS NULL THEN pred_y ELSE greatest(0, least(y * fy + cy, 3015)) END AS pred_y FROM ({inner})"""


@query("rectified_points", _rectify_sql(), ("predictions", "frames"), "pred_x pred_y", 5)
def rectified_points(spark, sf):
    rows = v.predictions(spark, sf).join(v.frames(spark, sf).select("image_id", "rig_id"), "image_id")
    sized = rows.withColumn("width", F.lit(v.WIDTH)).withColumn("height", F.lit(v.HEIGHT))
    return pk.rectify_points(sized, v.intrinsics(spark)).select("image_id", "pred_x", "pred_y")


# Candidate peaks ----------------------------------------------------------------------------

def best_sql(prior: bool, corridor: bool) -> str:
    value = "1 / (1 + exp(-logit))"
    if prior:
        value += f" * {prior_sql('tile_x + x', 'tile_y + y')}"
    if corridor:
        value += """ * CASE WHEN line_confidence > 0 AND line_a IS NOT NULL AND abs(line_a * (tile_x + x) + line_b * (tile_y + y) + line_c)
          / sqrt(line_a * line_a + line_b * line_b) > 25 THEN 0 ELSE 1 END"""
    return f"""SELECT image_id, tile_idx, tile_x, tile_y, x, y, logit, value, presence_max AS presence, width, height, line_a, line_b, line_c, line_confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY value DESC, tile_idx, y, x) AS place, max(presence) OVER (PARTITION BY image_id) AS presence_max
      FROM (SELECT c.*, g.* EXCLUDE (image_id), {value} AS value FROM candidates c JOIN gate g USING (image_id))) WHERE place = 1"""


@query("merged_peaks", f"SELECT image_id, tile_idx, x, y, value, presence FROM ({best_sql(True, True)})", ("candidates", "gate"), "value presence")
def merged_peaks(spark, sf):
    gate = pk.line_gate(v.records(spark, sf))
    return pk.best_peaks(v.candidates(spark, sf), gate, PRIOR, 25.0).select(
        "image_id", "tile_idx", "x", "y", "value", "presence")


def subpixel_sql(source: str) -> str:
    def shift(lo: str, hi: str) -> str:
        bend = f"({lo} - 2.0 * logit + {hi})"
        raw = f"(0.5 * ({lo} - {hi}) / {bend})"
        return (f"CASE WHEN lf IS NULL OR rt IS NULL OR up IS NULL OR dn IS NULL OR x <= 0 OR x >= 1023 OR y <= 0 OR y >= 1023 OR abs({bend}) <= 1e-12 "
                f"THEN 0 WHEN {raw} > -0.5 AND {raw} < 0.5 THEN {raw} ELSE 0 END")

    return f"""SELECT *, {shift('lf', 'rt')} AS shift_x, {shift('up', 'dn')} AS shift_y FROM (
      SELECT b.*, (SELECT max(logit) FROM candidates c WHERE c.image_id = b.image_id AND c.tile_idx = b.tile_idx AND c.x = b.x - 1 AND c.y = b.y) AS lf,
        (SELECT max(logit) FROM candidates c WHERE c.image_id = b.image_id AND c.tile_idx = b.tile_idx AND c.x = b.x + 1 AND c.y = b.y) AS rt,
        (SELECT max(logit) FROM candidates c WHERE c.image_id = b.image_id AND c.tile_idx = b.tile_idx AND c.x = b.x AND c.y = b.y - 1) AS up,
        (SELECT max(logit) FROM candidates c WHERE c.image_id = b.image_id AND c.tile_idx = b.tile_idx AND c.x = b.x AND c.y = b.y + 1) AS dn
      FROM ({source}) b)"""


@query("subpixel_peaks", f"SELECT image_id, x, y, shift_x, shift_y FROM ({subpixel_sql(best_sql(False, False))})", ("candidates", "gate"), "shift_x shift_y")
def subpixel_peaks(spark, sf):
    c = v.candidates(spark, sf)
    return pk.refine_subpixel(pk.best_peaks(c, pk.line_gate(v.records(spark, sf), False)), c).select(
        "image_id", "x", "y", "shift_x", "shift_y")


def snap_sql(source: str, alpha_max: str, x: str, y: str, conf: str) -> str:
    return f"""SELECT *, CASE WHEN line_a IS NULL OR line_confidence <= 0 THEN {x} ELSE greatest(0, least({x} - alpha * t * line_a, width - 1)) END AS sx,
      CASE WHEN line_a IS NULL OR line_confidence <= 0 THEN {y} ELSE greatest(0, least({y} - alpha * t * line_b, height - 1)) END AS sy FROM (
      SELECT *, (line_a * {x} + line_b * {y} + line_c) / (line_a * line_a + line_b * line_b) AS t,
        greatest(CAST(0 AS DOUBLE), least(1 / (1 + exp(-(least(line_confidence, 600) - 5))) * (1 - {conf}), CAST({alpha_max} AS DOUBLE))) AS alpha FROM ({source}))"""


def merged_sql(alpha_max: str) -> str:
    placed = f"""SELECT *, presence AS conf, least(tile_x + x + shift_x, width - 1) AS px, least(tile_y + y + shift_y, height - 1) AS py
      FROM ({subpixel_sql(best_sql(True, True))})"""
    return snap_sql(placed, alpha_max, "px", "py", "conf")


@query("merged_predictions", f"""
SELECT image_id, CASE WHEN conf >= 0.4 THEN sx END AS pred_x, CASE WHEN conf >= 0.4 THEN sy END AS pred_y, conf AS pred_confidence,
  CASE WHEN conf >= 0.4 THEN value END AS peak_value FROM ({merged_sql('0.3')})
""", ("candidates", "gate"), "pred_x pred_y pred_confidence peak_value", 5)
def merged_predictions(spark, sf):
    return pk.merge_tiles(
        v.candidates(spark, sf), pk.line_gate(v.records(spark, sf)), PRIOR, 25.0, True, 0.4)


def _refined(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return v.table(spark, sf, "events").select(
        i.alias("image_id"), (1400 + (i * 7) % 900).cast("double").alias("ref_x"), (1100 + (i * 11) % 500).cast("double").alias("ref_y"),
        ((i * 31) % 1000 / F.lit(1000)).alias("ref_value"), ((i * 17) % 1000 / F.lit(1000)).alias("ref_presence"))


TWO_PASS = f"""
SELECT *, pred_x IS NULL OR ref_value < CAST(0.5 AS DOUBLE) * conf OR ref_presence < CAST(0.3 AS DOUBLE) AS fell_back, greatest(conf, ref_presence) AS top FROM (
  SELECT m.image_id, m.width, m.height, m.line_a, m.line_b, m.line_c, m.line_confidence, m.conf, CASE WHEN m.conf >= 0.3 THEN m.sx END AS pred_x, CASE WHEN m.conf >= 0.3 THEN m.sy END AS pred_y,
    CAST(1400 + (image_id * 7) % 900 AS DOUBLE) AS ref_x, CAST(1100 + (image_id * 11) % 500 AS DOUBLE) AS ref_y,
    CAST((image_id * 31) % 1000 AS DOUBLE) / 1000 AS ref_value, CAST((image_id * 17) % 1000 AS DOUBLE) / 1000 AS ref_presence FROM ({merged_sql('0')}) m)
"""


@query("two_pass_predictions", f"""
SELECT image_id, CASE WHEN fell_back THEN pred_x ELSE ux END AS pred_x, CASE WHEN fell_back THEN pred_y ELSE uy END AS pred_y,
  CASE WHEN fell_back THEN conf ELSE top END AS pred_confidence, fell_back FROM (
  SELECT * EXCLUDE (sx, sy), sx AS ux, sy AS uy FROM ({snap_sql(TWO_PASS, '0.3', 'ref_x', 'ref_y', 'top')}))
""", ("candidates", "gate"), "pred_x pred_y pred_confidence", 5)
def two_pass_predictions(spark, sf):
    gate = pk.line_gate(v.records(spark, sf))
    coarse = pk.merge_tiles(v.candidates(spark, sf), gate, PRIOR, 25.0, True, 0.3, alpha_max=0.0).drop("peak_value")
    return pk.resolve_two_pass(coarse, _refined(spark, sf), gate, 0.3)


@query("refine_windows", """
SELECT image_id, greatest(0, least(4014, greatest(0, CAST(round_even(pred_x, 0) AS BIGINT) - 128) + 256) - 256) AS tile_x,
  greatest(0, least(3016, greatest(0, CAST(round_even(pred_y, 0) AS BIGINT) - 128) + 256) - 256) AS tile_y FROM predictions WHERE pred_x IS NOT NULL
""", ("predictions",))
def refine_windows(spark, sf):
    sized = v.predictions(spark, sf).withColumn("width", F.lit(v.WIDTH)).withColumn("height", F.lit(v.HEIGHT))
    return pk.refine_window(sized, 256)


SOFT = """
SELECT image_id, tile_idx, sum(w * (tile_x + x)) / sum(w) AS soft_x, sum(w * (tile_y + y)) / sum(w) AS soft_y FROM (
  SELECT *, exp(logit - max(logit) OVER (PARTITION BY image_id, tile_idx)) AS w FROM candidates) GROUP BY image_id, tile_idx
"""


@query("soft_argmax", SOFT, ("candidates",), "soft_x soft_y")
def soft_argmax(spark, sf):
    return pk.soft_argmax(v.candidates(spark, sf))


@query("line_consistency", f"""
SELECT sum(abs(line_a * soft_x + line_b * soft_y + line_c) * line_confidence) FILTER (WHERE valid) / greatest(sum(line_confidence) FILTER (WHERE valid), 1) AS line_loss,
  count(*) FILTER (WHERE valid) AS n_valid FROM (
  SELECT *, coalesce(is_line_confident AND is_positive AND tile_idx = 0, false) AS valid FROM ({SOFT}) JOIN records USING (image_id))
""", ("candidates", "records"), "line_loss")
def line_consistency(spark, sf):
    soft = pk.soft_argmax(v.candidates(spark, sf)).hint("merge").join(v.records(spark, sf), "image_id")
    valid = F.coalesce(F.col("is_line_confident") & F.col("is_positive") & (F.col("tile_idx") == 0), F.lit(False))
    return pk.line_consistency(soft.withColumn("valid", valid))


CONFIGS = [
    {"label": f"floor{f}_sigma{s}", "floor": f, "sigma_x": s, "sigma_y": s} for f in (0.0, 0.5, 1.0) for s in (200.0, 600.0)]


def _sweep_sql() -> str:
    rows = ", ".join(
        f"('{c['label']}', CAST({c['floor']} AS DOUBLE), CAST({c['sigma_x']} AS DOUBLE), CAST({c['sigma_y']} AS DOUBLE))" for c in CONFIGS)
    return f"""
WITH peaks AS (
  SELECT label, floor, sigma_x, sigma_y, image_id, CAST(tile_x + x AS DOUBLE) AS px, CAST(tile_y + y AS DOUBLE) AS py, conf FROM (
    SELECT *, row_number() OVER (PARTITION BY label, image_id ORDER BY value DESC, tile_idx, y, x) AS place, max(presence) OVER (PARTITION BY label, image_id) AS conf FROM (
      SELECT c.*, k.*, 1 / (1 + exp(-logit)) * {prior_sql('tile_x + x', 'tile_y + y', 'floor', 'sigma_x', 'sigma_y')} AS value
      FROM candidates c, (VALUES {rows}) k(label, floor, sigma_x, sigma_y))) WHERE place = 1),
scored AS (SELECT p.*, f.is_positive, sqrt((px - label_x) * (px - label_x) + (py - label_y) * (py - label_y)) AS e FROM peaks p JOIN frames f USING (image_id)),
ranked AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY conf) + CAST(count(*) OVER (PARTITION BY label, conf) - 1 AS DOUBLE) / 2 AS r FROM scored)
SELECT label, floor, sigma_x, sigma_y, avg(CAST(e <= 3 AS INTEGER)) FILTER (WHERE is_positive) AS hit_rate_n3, avg(CAST(e <= 4 AS INTEGER)) FILTER (WHERE is_positive) AS hit_rate_n4,
  (sum(r) FILTER (WHERE is_positive) - CAST(count(*) FILTER (WHERE is_positive) AS DOUBLE) * (count(*) FILTER (WHERE is_positive) + 1) / 2)
    / (CAST(count(*) FILTER (WHERE is_positive) AS DOUBLE) * count(*) FILTER (WHERE NOT is_positive)) AS presence_auroc,
  avg(CAST(conf >= 0.5 AS INTEGER)) FILTER (WHERE NOT is_positive) AS fpr_at_threshold, avg(e) FILTER (WHERE is_positive) AS mean_pixel_error,
  quantile_cont(e, 0.5) FILTER (WHERE is_positive) AS median_pixel_error FROM ranked GROUP BY label, floor, sigma_x, sigma_y
"""


@query("prior_sweep", f"SELECT * FROM ({_sweep_sql()})", ("candidates", "frames"),
       "floor sigma_x sigma_y hit_rate_n3 hit_rate_n4 presence_auroc fpr_at_threshold mean_pixel_error median_pixel_error", 5)
def prior_sweep(spark, sf):
    return cmp.prior_sweep(v.candidates(spark, sf), v.frames(spark, sf), CONFIGS)


# Pixels ------------------------------------------------------------------------------------------

@query("pixel_masks", """
SELECT image_id, count(*) FILTER (WHERE ((hue BETWEEN 0 AND 15) OR (hue BETWEEN 160 AND 179)) AND sat >= 100 AND v >= 200) AS n_red,
  count(*) FILTER (WHERE hue BETWEEN 35 AND 95 AND sat >= 100 AND v >= 200) AS n_green, count(*) FILTER (WHERE sat > 60 AND v > 200) AS n_audit FROM hsv GROUP BY image_id
""", ("hsv",))
def pixel_masks(spark, sf):
    bgr = (F.col("b"), F.col("g"), F.col("r"))
    return v.pixels(spark, sf).groupBy("image_id").agg(
        F.count_if(px.colour_mask(*bgr, F.lit("red"))).alias("n_red"),
        F.count_if(px.colour_mask(*bgr, F.lit("green"))).alias("n_green"),
        F.count_if(px.audit_mask(*bgr)).alias("n_audit"))


@query("pixel_chromaticity", """
SELECT image_id, sum(CAST(r AS DOUBLE) / 255 / greatest(CAST(r + g + b AS DOUBLE) / 255, CAST(0.001 AS DOUBLE))) AS share_r,
  sum(CAST(g AS DOUBLE) / 255 / greatest(CAST(r + g + b AS DOUBLE) / 255, CAST(0.001 AS DOUBLE))) AS share_g FROM pixels GROUP BY image_id
""", ("pixels",), "share_r share_g")
def pixel_chromaticity(spark, sf):
    return ra.chromaticity_table(v.pixels(spark, sf)).groupBy("image_id").agg(
        F.sum("share_r").alias("share_r"), F.sum("share_g").alias("share_g"))


@query("colour_values", "SELECT dive_id, CASE wavelength WHEN 'red' THEN 1.0 WHEN 'green' THEN 0.0 ELSE 0.5 END AS colour_value FROM tags", ("tags",), "colour_value")
def colour_values(spark, sf):
    return v.tags(spark, sf).select("dive_id", colour_value(F.col("wavelength")).alias("colour_value"))


@query("labels_in_raster", "SELECT image_id, CASE WHEN label_x >= 0 AND label_x < 2048 AND label_y >= 0 AND label_y < 1400 THEN label_x END AS kept_x FROM frames", ("frames",), "kept_x")
def labels_in_raster(spark, sf):
    inside = geo.in_bounds(F.col("label_x"), F.col("label_y"), F.lit(2048), F.lit(1400))
    return v.frames(spark, sf).select("image_id", F.when(inside, F.col("label_x")).alias("kept_x"))


PATCH_SQL = """
SELECT p.dive_id, p.image_id, x.b, x.g, x.r FROM (
  SELECT f.dive_id, image_id, cx, cy, row_number() OVER (PARTITION BY f.dive_id ORDER BY image_id) AS k
  FROM frames f JOIN rasters USING (image_id) WHERE is_positive) p
JOIN hsv x ON x.image_id = p.image_id AND x.x BETWEEN cx - 5 AND cx + 5 AND x.y BETWEEN cy - 5 AND cy + 5 WHERE p.k <= 10
QUALIFY row_number() OVER (PARTITION BY p.image_id ORDER BY x.v DESC, x.y, x.x) = 1
"""


@query("dive_colours", f"SELECT dive_id, avg(b) AS dive_color_b, avg(g) AS dive_color_g, avg(r) AS dive_color_r FROM ({PATCH_SQL}) GROUP BY dive_id",
       ("frames", "hsv"), "dive_color_b dive_color_g dive_color_r")
def dive_colours(spark, sf):
    return tg.dive_colours(v.pixel_frames(spark, sf), v.rasters(spark, sf))


# The dots of the derived rasters are red or green, so the cheapest two groups are told apart by r > g.
@query("clustered_tags", f"""
SELECT d.dive_id, coalesce(m.wavelength, CASE WHEN c.r > c.g THEN 'red' WHEN c.r <= c.g THEN 'green' END) AS wavelength,
  CASE WHEN m.wavelength IS NOT NULL THEN 'label_string' WHEN c.r IS NOT NULL THEN 'color_cluster' END AS wavelength_source,
  c.b AS dive_color_b, c.g AS dive_color_g, c.r AS dive_color_r
FROM (SELECT DISTINCT dive_id FROM frames) d LEFT JOIN majority m USING (dive_id)
LEFT JOIN (SELECT dive_id, avg(b) AS b, avg(g) AS g, avg(r) AS r FROM ({PATCH_SQL}) GROUP BY dive_id) c USING (dive_id)
""", ("frames", "hsv", "majority"), "dive_color_b dive_color_g dive_color_r")
def clustered_tags(spark, sf):
    return tg.infer_tags(v.pixel_frames(spark, sf), v.rasters(spark, sf))


def components_sql(mask: str, name: str) -> str:
    """Recursive reach of each mask pixel; the least reachable pixel names the blob."""
    return f"""{name}_px AS (SELECT image_id, x, y, y * 1000 + x AS n, v FROM ({mask})),
{name}_reach(image_id, n, x, y) AS (
  SELECT image_id, n, x, y FROM {name}_px
  UNION SELECT r.image_id, r.n, p.x, p.y FROM {name}_reach r JOIN {name}_px p
    ON p.image_id = r.image_id AND p.x BETWEEN r.x - 1 AND r.x + 1 AND p.y BETWEEN r.y - 1 AND r.y + 1),
{name} AS (
  SELECT p.image_id, p.x, p.y, p.v, q.label FROM {name}_px p JOIN (
    SELECT image_id, n, min(y * 1000 + x) AS label FROM {name}_reach GROUP BY image_id, n) q ON p.image_id = q.image_id AND p.n = q.n)"""


DETECT_MASK = """SELECT h.image_id, h.x, h.y, h.v FROM hsv h JOIN frames f USING (image_id) LEFT JOIN tags t USING (dive_id)
  WHERE sat >= 100 AND v >= 200 AND CASE wavelength WHEN 'red' THEN hue <= 15 OR hue >= 160 WHEN 'green' THEN hue BETWEEN 35 AND 95
    ELSE hue <= 15 OR hue >= 160 OR hue BETWEEN 35 AND 95 END"""


BLOBS_SQL = f"""
SELECT * FROM (WITH RECURSIVE {components_sql(DETECT_MASK, 'blob')}
SELECT image_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy, avg(v) AS mean_val FROM blob GROUP BY image_id, label)
"""


@query("blobs", BLOBS_SQL, ("hsv", "frames", "tags"), "cx cy mean_val")
def blobs(spark, sf):
    return _blobs_of(v.rasters(spark, sf), spark, sf)


def _blobs_of(raster: DataFrame, spark, sf) -> DataFrame:
    tagged = v.frames(spark, sf).select("image_id", "dive_id").join(
        v.tags(spark, sf).select("dive_id", "wavelength"), "dive_id", "left")
    return ra.tagged_blobs(raster, tagged).select("image_id", "area", "cx", "cy", "mean_val")


@query("blobs_across_strips", BLOBS_SQL, ("hsv", "frames", "tags"), "cx cy mean_val")
def blobs_across_strips(spark, sf):
    """The blobs of images that come in strips of five rows."""
    return _blobs_of(v.raster_strips(spark, sf), spark, sf)


@query("blobs_of_pixel_rows", BLOBS_SQL, ("hsv", "frames", "tags"), "cx cy mean_val")
def blobs_of_pixel_rows(spark, sf):
    """The blobs of images that are tables of pixels."""
    return _blobs_of(v.pixels(spark, sf), spark, sf)


@query("classical_predictions", f"""
SELECT * FROM (WITH RECURSIVE {components_sql(DETECT_MASK, 'blob')}
SELECT f.image_id, cx AS pred_x, cy AS pred_y, CASE WHEN score IS NULL THEN 0 ELSE least(score, 1) END AS pred_confidence FROM frames f LEFT JOIN (
  SELECT image_id, cx, cy, score, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 9) DESC, label) AS place FROM (
    SELECT image_id, label, cx, cy, mv / 255 * CASE WHEN dive_id % 3 <> 0 THEN
        exp(-pow(abs(CAST(0.6 AS DOUBLE) * cx + CAST(0.8 AS DOUBLE) * cy - dive_id % 10), 2) / 162) ELSE 1 END AS score
    FROM (SELECT image_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, avg(v) AS mv FROM blob GROUP BY image_id, label) JOIN frames USING (image_id)
    WHERE area BETWEEN 3 AND 1000) WHERE score > 0) d ON f.image_id = d.image_id AND d.place = 1)
""", ("hsv", "frames", "tags"), "pred_x pred_y pred_confidence")
def classical_predictions(spark, sf):
    return ra.classical_predictions(
        v.frames(spark, sf), v.rasters(spark, sf), v.tags(spark, sf), v.pixel_lines(spark, sf))


# Reach of the labelled pixel over audit pixels inside its patch, and the patch's size inside the raster.
AUDIT_SQL = """
WITH RECURSIVE asked AS (
  SELECT f.dive_id, f.image_id, t.wavelength, p.cx, p.cy,
    (least(p.cx + 31, p.w - 1) - greatest(p.cx - 31, 0) + 1) * (least(p.cy + 31, p.h - 1) - greatest(p.cy - 31, 0) + 1) AS patch_size
  FROM frames f JOIN rasters p USING (image_id) LEFT JOIN tags t ON t.dive_id = f.dive_id WHERE f.is_positive),
spots AS (SELECT image_id, x, y FROM hsv WHERE sat > 60 AND v > 200),
reach(image_id, cx, cy, x, y) AS (
  SELECT a.image_id, a.cx, a.cy, s.x, s.y FROM asked a JOIN spots s ON s.image_id = a.image_id AND s.x = a.cx AND s.y = a.cy
  UNION SELECT r.image_id, r.cx, r.cy, s.x, s.y FROM reach r JOIN spots s ON s.image_id = r.image_id
    AND s.x BETWEEN r.x - 1 AND r.x + 1 AND s.y BETWEEN r.y - 1 AND r.y + 1
    AND s.x BETWEEN r.cx - 31 AND r.cx + 31 AND s.y BETWEEN r.cy - 31 AND r.cy + 31)
SELECT dive_id, image_id, wavelength, 2 * sqrt(n / pi()) AS blob_diameter_px, n AS blob_pixels FROM asked
JOIN (SELECT image_id, count(*) AS n FROM reach GROUP BY image_id) USING (image_id) WHERE n <= 0.25 * patch_size
"""


@query("blobs_under_labels", f"SELECT image_id, blob_diameter_px, blob_pixels FROM ({AUDIT_SQL})", ("hsv", "frames", "tags"), "blob_diameter_px")
def blobs_under_labels(spark, sf):
    points = v.pixel_frames(spark, sf).filter(F.col("is_positive"))
    return ra.blob_under_label(points, v.rasters(spark, sf)).select("image_id", "blob_diameter_px", "blob_pixels")


SAMPLED_AUDIT = f"""
SELECT * FROM ({AUDIT_SQL}) WHERE image_id IN (
  SELECT image_id FROM (
    SELECT image_id, row_number() OVER (PARTITION BY dive_id ORDER BY md5('0:' || image_id), image_id) AS p
    FROM frames WHERE is_positive AND dive_id IN (
      SELECT dive_id FROM frames WHERE is_positive GROUP BY dive_id ORDER BY md5('0:' || dive_id), dive_id LIMIT 30)) WHERE p <= 5)
"""


def _audit(spark, sf) -> DataFrame:
    return ra.size_audit(v.pixel_frames(spark, sf), v.tags(spark, sf), v.rasters(spark, sf))


@query("size_audit", SAMPLED_AUDIT, ("hsv", "frames", "tags"), "blob_diameter_px")
def size_audit(spark, sf):
    return _audit(spark, sf)


@query("size_distribution", f"""
SELECT quantile_cont(blob_diameter_px, 0.0) AS d_min, quantile_cont(blob_diameter_px, 0.1) AS d_p10, quantile_cont(blob_diameter_px, 0.5) AS d_median,
  quantile_cont(blob_diameter_px, 0.9) AS d_p90, quantile_cont(blob_diameter_px, 1.0) AS d_max FROM ({SAMPLED_AUDIT})
""", ("hsv", "frames", "tags"), "d_min d_p10 d_median d_p90 d_max")
def size_distribution(spark, sf):
    return sm.size_distribution(_audit(spark, sf))


AUDIT_PICKS = f"""
SELECT image_id, pick FROM (
  (SELECT image_id, 'largest' AS pick FROM ({SAMPLED_AUDIT}) ORDER BY blob_diameter_px DESC, image_id LIMIT 15)
  UNION ALL
  SELECT image_id, 'spread' FROM (
    SELECT *, row_number() OVER (PARTITION BY wavelength ORDER BY blob_diameter_px, image_id) - 1 AS i, count(*) OVER (PARTITION BY wavelength) AS n
    FROM ({SAMPLED_AUDIT}) WHERE wavelength IN ('red', 'green')) WHERE i IN (0, n // 4, n // 2, 3 * n // 4, n - 1))
"""


@query("audit_picks", AUDIT_PICKS, ("hsv", "frames", "tags"))
def audit_picks(spark, sf):
    return sm.audit_picks(_audit(spark, sf)).select("image_id", "pick")


@query("audit_picks_with_frames", f"""
SELECT p.image_id, pick, image_path, image_checksum, label_x, label_y FROM ({AUDIT_PICKS}) p LEFT JOIN frames f USING (image_id)
""", ("hsv", "frames", "tags"), "label_x label_y")
def audit_picks_with_frames(spark, sf):
    picks = sm.audit_picks(_audit(spark, sf)).select("image_id", "pick")
    return sm.picks_with_frames(picks, v.frames(spark, sf))


CELLS = """
SELECT image_id, x // 2 AS cell_x, y // 2 AS cell_y, greatest(g - greatest(rr, bb), 0) AS g_excess, greatest(rr - greatest(g, bb), 0) AS r_excess, g1 - g2 AS g_diff FROM (
  SELECT image_id, x, y, (g1 + g2) // 2 AS g, rr, bb, g1, g2 FROM (
    SELECT image_id, x, y, greatest(s(x, y) - 64, 0) AS rr, greatest(s(x + 1, y) - 60, 0) AS g1, greatest(s(x, y + 1) - 62, 0) AS g2, greatest(s(x + 1, y + 1) - 66, 0) AS bb
    FROM (SELECT event_id AS image_id, x, y FROM events, (SELECT unnest([0, 2]) AS x), (SELECT unnest([0, 2]) AS y))))
""".replace("s(x, y)", "(image_id * 37 + x * 101 + y * 211) % 1024").replace(
    "s(x + 1, y)", "(image_id * 37 + (x + 1) * 101 + y * 211) % 1024").replace(
    "s(x, y + 1)", "(image_id * 37 + x * 101 + (y + 1) * 211) % 1024").replace(
    "s(x + 1, y + 1)", "(image_id * 37 + (x + 1) * 101 + (y + 1) * 211) % 1024")


def _cells(spark, sf) -> DataFrame:
    return ra.cell_features(v.photosites(spark, sf), black=(64, 60, 66, 62))


@query("cell_features", CELLS.replace("x // 2 AS cell_x, y // 2 AS cell_y", "CAST(x // 2 AS BIGINT) AS cell_x, CAST(y // 2 AS BIGINT) AS cell_y"))
def cell_features(spark, sf):
    return _cells(spark, sf)


@query("upsampled_cells", f"""
SELECT image_id, CAST(cell_x * 2 + dx AS BIGINT) AS x, CAST(cell_y * 2 + dy AS BIGINT) AS y, g_excess FROM ({CELLS}), (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)
WHERE cell_x * 2 + dx < 3
""")
def upsampled_cells(spark, sf):
    return ra.upsample_cells(_cells(spark, sf), width=3).select("image_id", "x", "y", "g_excess")
