"""Frames, predictions and the other inputs derived from the driver's tables.

The tables hold no dives, so each ``events`` row becomes a frame: the user is
the dive, the value moves the point along the dive's line, and multiplicative
hashes of the id give noise, gross errors and predictions.  Every view covers
its whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.operators.frames import join_predictions
from sightline.operators.lines import least_squares_lines
from sightline.operators.splits import make_splits
from sightline.operators.strata import enrich, failures
from sightline.operators.tags import resolve_tags
from sightline.session import cut_lineage
from sightline.sources.images import pixel_table

# Raster size of every derived image.
WIDTH, HEIGHT = 4014, 3016
RIGS = 7


@cache
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _geometry(events: DataFrame) -> DataFrame:
    user, event, value = F.col("user_id"), F.col("event_id"), F.col("value")
    flat = user % 10 == 9
    lx = F.when(flat, F.lit(1500) + value * F.lit(0.03)).otherwise(F.lit(1200) + value * F.lit(4))
    slope = F.when(flat, F.lit(0.0)).otherwise((user % 9 - 4) / F.lit(8))
    noise = (event * 7919) % 401 / F.lit(100) - F.lit(2)
    gross = F.when((event % 41 == 0) & ~flat, F.lit(60)).otherwise(F.lit(0))
    return (
        events.withColumn("labelled", F.when(user % 25 == 24, event % 20 == 0).otherwise(
            F.col("event_type") != "error"))
        .withColumn("lx", lx)
        .withColumn("ly", F.lit(1400) + slope * (F.col("lx") - F.lit(1800)) + noise + gross)
    )


@cache
def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = _geometry(table(spark, sf, "events"))
    user, event = F.col("user_id"), F.col("event_id")
    superseded = F.when(event % 31 == 0, F.lit(True)).when(
        event % 97 == 1, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    label = (
        F.when(user % 6 == 5, F.lit(None).cast("string"))
        .when(user % 6 < 3, F.when(event % 12 == 0, F.lit("Green dot")).otherwise(F.lit("Red dot")))
        .otherwise(F.when(event % 12 == 0, F.lit("red dot")).otherwise(F.lit("dot-green")))
    )
    return e.select(
        user.alias("dive_id"), event.alias("image_id"), (user % RIGS).alias("rig_id"),
        F.concat(F.lit("d"), user.cast("string"), F.lit("/"), event.cast("string"), F.lit(".png"))
        .alias("image_path"),
        F.md5(event.cast("string")).alias("image_checksum"),
        F.when(F.col("labelled"), F.col("lx")).alias("label_x"),
        F.when(F.col("labelled"), F.col("ly")).alias("label_y"),
        (F.col("labelled") & ~F.coalesce(superseded, F.lit(False))).alias("is_positive"),
        label.alias("label_string"),
        (event + 1_000_000).alias("label_studio_task_id"), (user % 3).alias("label_studio_project_id"),
        superseded.alias("superseded"), F.lit(True).alias("completed"))


@cache
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    e = _geometry(table(spark, sf, "events"))
    event = F.col("event_id")
    missing = event % 19 == 0
    jump_x = F.when(event % 5 == 0, F.lit(3)).otherwise(F.lit(0))
    jump_y = F.when(event % 43 == 0, F.lit(600)).otherwise(F.lit(0))
    px = F.col("lx") + (event * 104729) % 801 / F.lit(160) - F.lit(2.5) + jump_x
    py = F.col("ly") + (event * 130363) % 801 / F.lit(160) - F.lit(2.5) + jump_y
    lift = F.when(F.col("labelled"), F.lit(300)).otherwise(F.lit(0))
    conf = ((event * 15485863) % 700 + lift) / F.lit(1000)
    return e.select(
        event.alias("image_id"),
        F.when(~missing, px).alias("pred_x"), F.when(~missing, py).alias("pred_y"),
        F.when(missing, F.lit(0.0)).otherwise(conf).alias("pred_confidence"))


@cache
def tags(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_tags(frames(spark, sf))


@cache
def splits(spark: SparkSession, sf: str) -> DataFrame:
    return make_splits(tags(spark, sf))


@cache
def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Plain least-squares lines: enough for joins and strata, one aggregate to build."""
    return least_squares_lines(frames(spark, sf))


@cache
def per_frame(spark: SparkSession, sf: str, split: str | None = None) -> DataFrame:
    return join_predictions(
        frames(spark, sf), predictions(spark, sf), splits(spark, sf), tags(spark, sf),
        lines(spark, sf), split)


@cache
def joined(spark: SparkSession, sf: str) -> DataFrame:
    """All frames with their dive facts and predictions, written once per session.

    The breakdown queries read it several times each.
    """
    return cut_lineage(per_frame(spark, sf))


@cache
def positives(spark: SparkSession, sf: str) -> DataFrame:
    return failures(joined(spark, sf))


@cache
def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich(joined(spark, sf))


def dives(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id").distinct().select(
        F.col("user_id").alias("dive_id"), (F.col("user_id") % RIGS).alias("camera_id"),
        (F.col("user_id") % 11 != 3).alias("is_canonical"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Images of the frames; every seventh one has an older duplicate."""
    f = frames(spark, sf).select("dive_id", "image_id", "image_path", "image_checksum")
    newest = f.withColumn("seq", F.lit(1))
    older = f.filter(F.col("image_id") % 7 == 0).withColumn(
        "image_path", F.concat(F.lit("old/"), F.col("image_path"))).withColumn("seq", F.lit(0))
    return newest.unionByName(older)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the frames; some without image id and some with two clicks."""
    f = frames(spark, sf).select(
        "dive_id",
        F.when(F.col("image_id") % 53 != 0, F.col("image_id")).alias("image_id"),
        F.col("label_x").alias("x"), F.col("label_y").alias("y"), F.col("label_string").alias("label"),
        "label_studio_task_id", "label_studio_project_id", "superseded", "completed")
    return f.unionByName(second_clicks(f))


def second_clicks(f: DataFrame) -> DataFrame:
    return f.filter(F.col("image_id") % 9 == 0).withColumn(
        "x", F.col("x") + F.lit(2)).withColumn("y", F.col("y") - F.lit(1)).withColumn(
        "label_studio_task_id", F.col("label_studio_task_id") + 5_000_000)


@cache
def flips(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 3, 5, 6)]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.md5(F.col("event_id").cast("string")).alias("image_checksum"),
        F.when(F.col("event_id") % 29 != 0, code).alias("flip"))


@cache
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Three tiles of five cells (a peak and its four neighbours) per image."""
    e = _geometry(table(spark, sf, "events"))
    tiles = F.array(*[
        F.struct(F.lit(i).cast("long").alias("t"), F.lit(x).cast("long").alias("ox"), F.lit(y).cast("long").alias("oy"))
        for i, (x, y) in enumerate(((768, 768), (1536, 768), (768, 1536)))])
    cells = F.array(*[
        F.struct(F.lit(k).cast("long").alias("k"), F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"))
        for k, (dx, dy) in enumerate(((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)))])
    event, t, k = F.col("event_id"), F.col("_t.t"), F.col("_k.k")
    base = e.withColumn("_t", F.explode(tiles)).withColumn("_k", F.explode(cells))
    peak = ((event * 7919 + t * 104729) % 997) / F.lit(125) - F.lit(4)
    drop = F.when(k == 0, F.lit(0.0)).otherwise(((event + k * 31) % 17 + 1) / F.lit(16))
    return base.select(
        event.alias("image_id"), t.alias("tile_idx"), F.col("_t.ox").alias("tile_x"), F.col("_t.oy").alias("tile_y"),
        ((event * 31 + t * 17) % 1022 + 1 + F.col("_k.dx")).alias("x"),
        ((event * 57 + t * 29) % 1022 + 1 + F.col("_k.dy")).alias("y"),
        (peak - drop).alias("logit"),
        (((event * 15485863 + t * 7) % 1000) / F.lit(1000)).alias("presence"))


@cache
def records(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their line facts and raster size."""
    f = frames(spark, sf).select("dive_id", "image_id", "rig_id", "label_x", "label_y", "is_positive")
    facts = lines(spark, sf).select(
        "dive_id", "line_a", "line_b", "line_c", "line_confidence", "is_line_confident")
    return f.join(facts, "dive_id", "left").withColumn("width", F.lit(WIDTH)).withColumn(
        "height", F.lit(HEIGHT))


def sized_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images of three raster sizes."""
    e = table(spark, sf, "events")
    pick = F.col("event_id") % 3
    return e.select(
        F.col("event_id").alias("image_id"),
        F.when(pick == 0, F.lit(2160)).when(pick == 1, F.lit(600)).otherwise(F.lit(HEIGHT)).alias("height"),
        F.when(pick == 0, F.lit(3840)).when(pick == 1, F.lit(800)).otherwise(F.lit(WIDTH)).alias("width"))


@cache
def intrinsics(spark: SparkSession) -> DataFrame:
    """Camera constants of all rigs but the last."""
    rows = [
        (r, 3000.0 + 10 * r, 3010.0 + 10 * r, 2007.0 + r, 1508.0 - r,
         [-0.02 + 0.001 * r, 0.004, 0.0002, -0.0001, 0.0005][: 4 if r == 2 else 5])
        for r in range(RIGS - 1)]
    return spark.createDataFrame(
        rows, "rig_id bigint, fx double, fy double, cx double, cy double, dist array<double>")


# Side of the small rasters, and (width, height) of the large ones, which every hundredth image has.
PATCH = 9
LARGE = (88, 82)


def is_large(image_id: Column) -> Column:
    return image_id % 100 == 7


def raster_size(image_id: Column) -> tuple[Column, Column]:
    return tuple(F.when(is_large(image_id), F.lit(side)).otherwise(F.lit(PATCH)).cast("long") for side in LARGE)


def raster_of(image_id: int, dive_id: int) -> np.ndarray:
    """(height, width, 3) blue, green, red of an image: dark ground, bright cells decided by the id.

    Cell (x, y) lights up where (7 id + 3 x y + 5 x + 2 y) mod 6 < 2; its colour is that of the dive's dot.
    Large rasters light up in blocks only, and every third of them has a pale disc at its label, too pale for
    the detector but not for the audit; every second disc is too large for a quarter of the patch.
    """
    w, h = LARGE if image_id % 100 == 7 else (PATCH, PATCH)
    y, x = np.mgrid[0:h, 0:w]
    lit = (image_id * 7 + x * y * 3 + x * 5 + y * 2) % 6 < 2
    if image_id % 100 == 7:
        lit &= (x % 8 < 6) & (y % 7 < 5) & ((x // 8 + y // 7 + image_id) % 4 == 0)
    tone, weak = 205 + (image_id + x * 3 + y * 7) % 50, 30 + (image_id + x + y) % 25
    red = dive_id % 6 < 3
    planes = [
        np.where(lit, weak, 40), np.where(lit, weak if red else tone, 30), np.where(lit, tone if red else weak, 20)]
    if image_id % 300 == 7:
        disc = (x - image_id % w) ** 2 + (y - image_id * 5 % h) ** 2 <= (400 if image_id % 600 == 7 else 144)
        planes = [np.where(disc, pale, plane) for pale, plane in zip((150, 150, 220), planes)]
    return np.stack(planes, axis=2).astype(np.uint8)


def render(image_path: str, image_checksum: str) -> np.ndarray | None:
    """The loader of the derived images: a path names dive and image; every 37th image is missing."""
    dive_id, image_id = (int(p) for p in image_path[1:].removesuffix(".png").split("/"))
    return None if image_id % 37 == 5 else raster_of(image_id, dive_id)


@cache
def rasters(spark: SparkSession, sf: str) -> DataFrame:
    """The image of every event, written once."""
    schema = "image_id long, height int, width int, n_channels int, data binary"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dives = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            grids = [raster_of(i, d) for i, d in zip(ids, dives)]
            shape = [pa.array([g.shape[k] for g in grids], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *shape, pa.array([g.tobytes() for g in grids], pa.binary())],
                ["image_id", "height", "width", "n_channels", "data"])

    return cut_lineage(table(spark, sf, "events").select("event_id", "user_id").mapInArrow(draw, schema))


@cache
def raster_strips(spark: SparkSession, sf: str) -> DataFrame:
    """The same images cut into strips of five raster rows."""
    rows = F.col("width") * F.col("n_channels")
    cut = rasters(spark, sf).withColumn("top", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(5))))
    height = F.least(F.lit(5), F.col("height") - F.col("top"))
    return cut.select(
        "image_id", "top", height.alias("height"), "width", "n_channels",
        F.substring("data", F.col("top") * rows + 1, height * rows).alias("data"))


@cache
def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """All pixels of the rasters as rows, written once."""
    return cut_lineage(pixel_table(rasters(spark, sf)))


@cache
def pixel_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames whose label lies inside their raster."""
    i = F.col("image_id")
    width, height = raster_size(i)
    return frames(spark, sf).withColumn(
        "label_x", F.when(F.col("is_positive"), (i % width).cast("double"))
    ).withColumn("label_y", F.when(F.col("is_positive"), ((i * 5) % height).cast("double")))


@cache
def pixel_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One line per dive through the small raster; two thirds are confident."""
    d = F.col("dive_id")
    return tags(spark, sf).select(
        "dive_id", F.lit(0.6).alias("line_a"), F.lit(0.8).alias("line_b"),
        (-(d % 10).cast("double")).alias("line_c"), F.lit(9.0).alias("line_confidence"),
        (d % 3 != 0).alias("is_line_confident"))


def photosites(spark: SparkSession, sf: str) -> DataFrame:
    """A 4x4 sensor mosaic per image."""
    side = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    e = table(spark, sf, "events").select("event_id").withColumn("y", F.explode(side)).withColumn(
        "x", F.explode(side))
    i, x, y = F.col("event_id"), F.col("x"), F.col("y")
    return e.select(i.alias("image_id"), "x", "y", ((i * 37 + x * 101 + y * 211) % 1024).alias("value"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean order price per status, read as the score history of three runs."""
    o = table(spark, sf, "orders")
    return o.groupBy(
        F.col("o_orderstatus").alias("run_id"),
        F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("epoch"),
    ).agg(F.floor(F.avg("o_totalprice")).cast("double").alias("score"))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; adding zero turns -0.0 into 0.0."""
    def fix(name: str, kind: str) -> Column:
        if kind != "double":
            return F.col(name)
        return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)

    return df.select(*[fix(n, k) for n, k in df.dtypes])
