"""Queries of the sources and sinks: image loader and store, logs, shards, scorer, crops."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sightline.operators import metrics as mt
from sightline.operators import tags as tg
from sightline.operators import tiles as tl
from sightline.operators.image_blocks import tile_crops
from sightline.schemas import RIG_INTRINSICS
from sightline.session import cut_lineage, ensure_checkpoint_dir
from sightline.sources import images as im
from sightline.sources import tables as tb
from sightline.sources.loaded import load_images
from sightline.sources.scoring import score_tiles
from workload import views as v
from workload.curation_queries import FULL_GRID
from workload.registry import QUERIES, query


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Sums of the colours of each image that the loader finds.
_FOUND_SUMS = """SELECT image_id, CAST(sum(b) AS BIGINT) AS sum_b, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(r) AS BIGINT) AS sum_r
  FROM pixels WHERE image_id % 37 <> 5 GROUP BY image_id"""


def _sums(images: DataFrame) -> DataFrame:
    return im.pixel_table(images).groupBy("image_id").agg(*[F.sum(c).alias(f"sum_{c}") for c in "bgr"])


@query("loaded_images", f"""
SELECT r.image_id, CASE WHEN image_id % 37 <> 5 THEN h END AS height, CASE WHEN image_id % 37 <> 5 THEN w END AS width, sum_b, sum_g, sum_r
FROM rasters r LEFT JOIN ({_FOUND_SUMS}) s USING (image_id)
""", ("pixels",))
def loaded_images(spark, sf):
    """Every frame with its image from a user's loader; missing ones keep their row."""
    frames = v.frames(spark, sf).select("image_id", "image_path", "image_checksum")
    loaded = cut_lineage(frames.join(load_images(frames, v.render), ["image_path", "image_checksum"], "left"))
    return loaded.select("image_id", "height", "width").join(_sums(loaded), "image_id", "left")


_SPLIT_FRAMES = """SELECT f.image_id % 37 <> 5 AS there FROM frames f JOIN splits s USING (dive_id) WHERE s.split = '{}'"""


@query("store_reports", " UNION ALL ".join(
    f"""SELECT '{run}' AS run, CASE WHEN there THEN '{state}' ELSE 'failed' END AS status, count(*) AS n,
      CAST(CASE WHEN there THEN {attempts} ELSE {retries} END * count(*) AS BIGINT) AS attempts FROM ({_SPLIT_FRAMES.format(split)}) GROUP BY there"""
    for run, split, state, attempts, retries in (
        ("1 val", "val", "decoded", 1, 1), ("2 val", "val", "warm", 0, 1), ("3 val, failed ones left", "val", "warm", 0, 0),
        ("4 test", "test", "decoded", 1, 1))), ("frames", "splits"))
def store_reports(spark, sf):
    """A split is decoded once; the second run calls the loader for what it could not read, or not at all."""
    store = im.ImageStore(spark, _folder(spark, "images"))
    frames, splits = v.frames(spark, sf), v.splits(spark, sf)
    reports = []
    for run, split, retry in (("1 val", "val", True), ("2 val", "val", True), ("3 val, failed ones left", "val", False), ("4 test", "test", True)):
        report = cut_lineage(im.warm_split(frames, splits, split, store, v.render, retry))
        reports.append(report.select(F.lit(run).alias("run"), "status", "n", "attempts"))
    return reports[0].unionByName(reports[1]).unionByName(reports[2]).unionByName(reports[3])


def _val_store(spark, sf) -> im.ImageStore:
    store = im.ImageStore(spark, _folder(spark, "images"))
    im.warm_split(v.frames(spark, sf), v.splits(spark, sf), "val", store, v.render)
    return store


@query("stored_images", f"""
SELECT image_id, sum_b, sum_g, sum_r FROM ({_FOUND_SUMS}) JOIN frames USING (image_id) JOIN splits USING (dive_id) WHERE split = 'val'
""", ("pixels", "frames", "splits"))
def stored_images(spark, sf):
    """The decoded images of a split, read from the store."""
    images = _val_store(spark, sf).images()
    ids = v.frames(spark, sf).select("image_id", "image_checksum")
    return _sums(ids.join(images, "image_checksum"))


@query("reencoded_store", f"""
SELECT step, CASE step WHEN 1 THEN n ELSE 0 END AS done, CASE step WHEN 1 THEN 0 ELSE n END AS skipped, CAST(0 AS BIGINT) AS failed
FROM (SELECT count(*) AS n FROM ({_SPLIT_FRAMES.format('val')}) WHERE there), (VALUES (1), (2)) t(step)
""", ("frames", "splits"))
def reencoded_store(spark, sf):
    """The store rewritten in another format, and a second time."""
    source, target = _val_store(spark, sf), im.ImageStore(spark, _folder(spark, "orc"), "orc")
    first, second = (
        cut_lineage(im.reencode_store(source, target)).select(F.lit(step).alias("step"), "done", "skipped", "failed")
        for step in (1, 2))
    return first.unionByName(second)


@query("stored_intrinsics", """
SELECT rig_id, count(*) AS n, avg(3000 + 10 * rig_id) AS fx, avg(1508 - rig_id) AS cy, avg(CASE rig_id WHEN 2 THEN 4 ELSE 5 END) AS n_dist
FROM frames WHERE rig_id < 6 GROUP BY rig_id
""", ("frames",), "fx cy n_dist")
def stored_intrinsics(spark, sf):
    """Frames with the camera constants of their rig, from the stored table; without a table there are none."""
    where = _folder(spark, "intrinsics")
    assert tb.read_intrinsics(spark, where) is None
    tb.write_table(v.intrinsics(spark).select(*RIG_INTRINSICS.fieldNames()), where)
    known = tb.read_intrinsics(spark, where)
    return v.frames(spark, sf).join(known, "rig_id").groupBy("rig_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fx").alias("fx"), F.avg("cy").alias("cy"),
        F.avg(F.size("dist").cast("double")).alias("n_dist"))


@query("logged_metrics", f"""
SELECT run_id, step, slice, metric, value FROM ({QUERIES["evaluate_val"].sql}), (VALUES ('a', CAST(0 AS BIGINT)), ('a', 1), ('b', 0)) t(run_id, step)
""", (), "value")
def logged_metrics(spark, sf):
    """Metrics of three steps, two of which are logged twice, read back."""
    where, metrics = _folder(spark, "metrics"), cut_lineage(QUERIES["evaluate_val"].run(spark, sf))
    for run, step in (("a", 0), ("a", 1), ("b", 0), ("a", 0), ("b", 0)):
        tb.log_metrics(metrics, where, run, step)
    return tb.read_metrics(spark, where)


@query("gathered_shards", "SELECT image_id % 5 AS shard, image_id, pred_x, pred_y FROM predictions", ("predictions",), "pred_x pred_y")
def gathered_shards(spark, sf):
    """Predictions written in shards, one of them twice, and gathered."""
    where = _folder(spark, "shards")
    rows = v.predictions(spark, sf).select((F.col("image_id") % 5).alias("shard"), "image_id", "pred_x", "pred_y")
    tb.replace_partitions(rows, where, ("shard",))
    tb.replace_partitions(rows.filter(F.col("shard") == 3), where, ("shard",))
    return tb.read_table(spark, where).select(F.col("shard").cast("long").alias("shard"), "image_id", "pred_x", "pred_y")


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a model: a peak per tile from the tile's place, a batch at a time."""
    for b in batches:
        seed = b.image_id * 31 + b.tile_idx * 17
        yield pd.DataFrame({
            "image_id": b.image_id, "tile_idx": b.tile_idx.astype("int64"), "tile_x": b.tile_x.astype("int64"),
            "tile_y": b.tile_y.astype("int64"), "x": seed % 1024, "y": (seed * 7) % 1024,
            "logit": (seed % 997) / 125.0 - 4.0, "presence": (seed % 100) / 100.0})


@query("scored_tiles", f"""
SELECT image_id, count(*) AS n, CAST(sum(x + tile_x) AS BIGINT) AS sum_x, CAST(sum(y + tile_y) AS BIGINT) AS sum_y, max(logit) AS best FROM (
  SELECT image_id, tile_x, tile_y, seed % 1024 AS x, (seed * 7) % 1024 AS y, CAST(seed % 997 AS DOUBLE) / 125 - 4 AS logit
  FROM (SELECT *, image_id * 31 + tile_idx * 17 AS seed FROM ({FULL_GRID}))) GROUP BY image_id
""", ("records",), "best")
def scored_tiles(spark, sf):
    """A user's scorer over all tiles of all frames."""
    scored = score_tiles(tl.tile_grid(v.records(spark, sf).select("image_id", "width", "height")), _score)
    return scored.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x") + F.col("tile_x")).alias("sum_x"),
        F.sum(F.col("y") + F.col("tile_y")).alias("sum_y"), F.max("logit").alias("best"))


def _raster_predictions(spark, sf) -> DataFrame:
    i = F.col("image_id")
    width, height = v.raster_size(i)
    return v.predictions(spark, sf).select(
        "image_id", ((i * 3) % width).cast("double").alias("pred_x"), ((i * 7) % height).cast("double").alias("pred_y"),
        "pred_confidence")


_COLD = """
SELECT dive_id, avg(b) AS dive_color_b, avg(g) AS dive_color_g, avg(r) AS dive_color_r FROM (
  SELECT p.dive_id, x.b, x.g, x.r FROM (
    SELECT f.dive_id, image_id, (image_id * 3) % w AS cx, (image_id * 7) % h AS cy,
      row_number() OVER (PARTITION BY f.dive_id ORDER BY image_id) AS k
    FROM frames f JOIN rasters USING (image_id) JOIN predictions USING (image_id) WHERE pred_confidence >= 0.5) p
  JOIN hsv x ON x.image_id = p.image_id AND x.x BETWEEN cx - 5 AND cx + 5 AND x.y BETWEEN cy - 5 AND cy + 5 WHERE p.k <= 10
  QUALIFY row_number() OVER (PARTITION BY p.image_id ORDER BY x.v DESC, x.y, x.x) = 1)
GROUP BY dive_id
"""


@query("cold_start_colours", f"SELECT *, CASE WHEN dive_color_r > dive_color_g THEN 'red' ELSE 'green' END AS cluster FROM ({_COLD})",
       ("frames", "hsv", "predictions"), "dive_color_b dive_color_g dive_color_r")
def cold_start_colours(spark, sf):
    """Colours of dives without labels, from confident predictions."""
    return tg.cold_start_tags(v.frames(spark, sf), _raster_predictions(spark, sf), v.rasters(spark, sf), 0.5)


@query("evaluate_empty_split", "SELECT 'overall' AS slice, 'n_frames' AS metric, CAST(0 AS DOUBLE) AS value")
def evaluate_empty_split(spark, sf):
    """A split that no dive has: no frame, and no metric is known."""
    return mt.evaluate(
        v.predictions(spark, sf), v.frames(spark, sf), v.splits(spark, sf), v.tags(spark, sf), v.lines(spark, sf), "holdout")


TILE, PAD = 16, 3


def _axis_sql(label: str, room: str, salt: str) -> str:
    unit = f"CAST(CAST('0x' || substr(md5('4/{salt}:' || image_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"
    low, high = f"greatest({label} - {TILE - PAD}, 0)", f"least({label} - {PAD}, {room})"
    middle = f"greatest(0, least({label} - {TILE // 2}, {room}))"
    lo = f"CASE WHEN biased THEN CASE WHEN {low} > {high} THEN {middle} ELSE {low} END ELSE 0 END"
    hi = f"CASE WHEN biased THEN CASE WHEN {low} > {high} THEN {middle} ELSE {high} END ELSE {room} END"
    return f"{lo} + least(CAST(floor({unit} * ({hi} - ({lo}) + 1)) AS BIGINT), {hi} - ({lo}))"


# Reflection without the edge: position p of a side of n pixels shows pixel m, or 2 (n - 1) - m where m is past the end.
def _mirror(at: str, side: str) -> str:
    m = f"(({at}) % (2 * ({side} - 1)))"
    return f"CASE WHEN {m} < {side} THEN {m} ELSE 2 * ({side} - 1) - {m} END"


@query("tile_crops", f"""
SELECT c.image_id, crop_x, crop_y, md5(string_agg(printf('%02x%02x%02x', p.b, p.g, p.r), '' ORDER BY ty, tx)) AS crop_md5,
  coalesce(any_value((least(lx + 9, 15) - greatest(lx - 9, 0) + 1) * (least(ly + 9, 15) - greatest(ly - 9, 0) + 1))
    FILTER (WHERE lx BETWEEN 0 AND 15 AND ly BETWEEN 0 AND 15), 0) AS n_target
FROM (
  SELECT *, cx - crop_x AS lx, cy - crop_y AS ly FROM (
    SELECT *, {_axis_sql("cx", "room_x", "x")} AS crop_x, {_axis_sql("cy", "room_y", "y")} AS crop_y FROM (
      SELECT r.image_id, w, h, greatest(w - {TILE}, 0) AS room_x, greatest(h - {TILE}, 0) AS room_y,
        CASE WHEN is_positive THEN cx END AS cx, CASE WHEN is_positive THEN cy END AS cy,
        is_positive AND CAST(CAST('0x' || substr(md5('4/b:' || image_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 < 0.7 AS biased
      FROM rasters r JOIN frames f USING (image_id) WHERE image_id % 37 <> 5))) c,
  unnest(range({TILE})) a(ty), unnest(range({TILE})) d(tx)
JOIN pixels p ON p.image_id = c.image_id AND p.x = {_mirror("crop_x + tx", "w")} AND p.y = {_mirror("crop_y + ty", "h")}
GROUP BY ALL
""", ("pixels", "frames"))
def tile_crops_query(spark, sf):
    """The pixels of a crop per frame, reflected where the image is smaller than the tile, and the cells of its target."""
    width, height = v.raster_size(F.col("image_id"))
    records = v.pixel_frames(spark, sf).select(
        "dive_id", "image_id", "label_x", "label_y", width.alias("width"), height.alias("height"),
        F.lit(None).cast("string").alias("wavelength"), F.lit(None).cast("double").alias("line_confidence"),
        F.lit(False).alias("is_line_confident"), *[F.lit(None).cast("double").alias(f"line_{k}") for k in "abc"])
    images = v.rasters(spark, sf).filter(F.col("image_id") % 37 != 5)
    tiles = cut_lineage(tl.training_tiles(records, images, TILE, PAD, seed=4))
    crops = tile_crops(tiles, images, TILE).select(
        "image_id", "crop_x", "crop_y", F.md5(F.lower(F.hex("crop"))).alias("crop_md5"))
    cells = tl.gaussian_target(tiles, TILE, TILE).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_target"))
    return crops.join(cells, "image_id", "left").withColumn("n_target", F.coalesce("n_target", F.lit(0)).cast("long"))
