"""Raster operators: blobs, the classical detector, size audit, cell features.

A raster argument is a table of images (image_id, height, width, n_channels,
data) or of pixels (image_id, x, y, b, g, r).  Images are labelled inside one
Arrow pass (``image_blocks``).  Pixel tables, which may be sparse, are labelled
on horizontal runs: inside bands of rows by an Arrow pass over sorted runs, and
from band to band by rounds of neighbour minimum and pointer jumping over the
bands' outer rows.  Each round is written to the checkpoint folder, so a lost
executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions.pixels import (
    MAX_PATCH_FRACTION, area_plausible, audit_mask, blob_score, chromaticity, colour_mask,
    equivalent_diameter, hsv)
from sightline.functions.geometry import perpendicular_distance
from sightline.functions.hashing import all_of
from sightline.operators.frames import classical_context, keep_members
from sightline.operators.image_blocks import (
    ROW_STEP, across_bands, blob_parts, blobs_at_centres, has_images, linked_parts, local_labels)
from sightline.operators.sampling import two_stage_sample
from sightline.session import cut_lineage, release

PATCH_HALF = 31


def pixel_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal horizontal runs with node id, extent and sums.

    ``mask`` has one row per mask pixel (keys, x, y, val).  A window covers one
    raster row of one image, so it is bounded by the image width.
    """
    row = Window.partitionBy(*keys, "y").orderBy("x")
    return (
        mask.withColumn("_island", F.col("x") - F.dense_rank().over(row))
        .groupBy(*keys, "y", "_island")
        .agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.count(F.lit(1)).alias("area"), F.sum("x").alias("sum_x"), F.sum("val").alias("sum_val"))
        .select(
            *keys, (F.col("y").cast("long") * F.lit(ROW_STEP) + F.col("x0")).alias("node"),
            "y", "x0", "x1", "area", "sum_x", "sum_val")
    )


def touching_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct pairs (u, v) of runs in adjacent rows that touch, corners included.

    Each run offers the pixels below it; the join is on single pixels, so its
    size is linear in the mask.
    """
    below = runs.select(
        *keys, (F.col("y") + 1).alias("y"), F.col("node").alias("u"),
        F.explode(F.sequence(F.col("x0") - 1, F.col("x1") + 1)).alias("x"))
    pixels = runs.select(
        *keys, "y", F.col("node").alias("v"), F.explode(F.sequence("x0", "x1")).alias("x"))
    return below.join(pixels, [*keys, "y", "x"]).select(*keys, "u", "v").distinct()


def component_labels(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, label): the smallest node id of each connected component.

    Runs one job per round until no label changes.  A round takes the least
    label among a node and its neighbours and then the label of that label, which
    doubles the reach.  A round's table is deleted when the next one is written.
    """
    keys = list(keys)
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    both = cut_lineage(both)
    labels = nodes.select(*keys, "node", F.col("node").alias("label"))
    # A node without neighbours is its own component from the start.
    linked = both.select(*keys, F.col("u").alias("node")).distinct()
    alone = labels.join(linked, [*keys, "node"], "left_anti")
    active = cut_lineage(labels.join(linked, [*keys, "node"], "left_semi"))
    while True:
        offers = both.join(
            active.select(*keys, F.col("node").alias("v"), "label"), [*keys, "v"]
        ).groupBy(*keys, F.col("u").alias("node")).agg(F.min("label").alias("_offer"))
        lowered = active.join(offers, [*keys, "node"], "left").select(
            *keys, "node", F.col("label").alias("_old"), F.least("label", "_offer").alias("_new"))
        jump = active.select(*keys, F.col("node").alias("_new"), F.col("label").alias("_jump"))
        moved = cut_lineage(lowered.join(jump, [*keys, "_new"], "left").select(
            *keys, "node", "_old", F.least("_new", "_jump").alias("label")))
        release(active)
        active = moved.select(*keys, "node", "label")
        if moved.filter(F.col("label") != F.col("_old")).isEmpty():
            return alone.unionByName(active)


def labelled_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs with the label of their component: band by band of rows, and then from band to band."""
    runs = pixel_runs(mask, keys).dropna(subset=[*keys, "y", "x0"])
    local = cut_lineage(local_labels(runs, keys))
    none = local.select(*keys, F.col("node").alias("u"), F.col("local").alias("v")).limit(0)
    return across_bands(local, none, keys, touching_runs, component_labels).drop("local")


def blobs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area, centroid and mean value per component."""
    area = F.sum("area")
    return runs.groupBy(*keys, "label").agg(
        area.alias("area"),
        (F.sum("sum_x") / area).alias("cx"),
        (F.sum(F.col("y") * F.col("area")) / area).alias("cy"),
        (F.sum("sum_val") / area).alias("mean_val"))


def image_blobs(images: DataFrame) -> DataFrame:
    """Blobs (image_id, tag, label, area, cx, cy, mean_val) of the detector masks of every image.

    Whole images take one pass without a shuffle.  Strips of an image (rows with ``top``) are merged on their
    outer rows, in rounds over these alone.
    """
    keys = ["image_id", "tag"]
    area = F.sum("area")
    if "top" in images.columns:
        parts = linked_parts(cut_lineage(blob_parts(images)), keys, touching_runs, component_labels)
        return parts.groupBy(*keys, "label").agg(
            area.alias("area"), (F.sum("sum_x") / area).alias("cx"), (F.sum("sum_y") / area).alias("cy"),
            (F.sum("sum_val") / area).alias("mean_val"))
    return blob_parts(images).select(
        *keys, F.col("node").alias("label"), "area", (F.col("sum_x") / F.col("area")).alias("cx"),
        (F.col("sum_y") / F.col("area")).alias("cy"), (F.col("sum_val") / F.col("area")).alias("mean_val"))


def tagged_blobs(raster: DataFrame, tagged: DataFrame) -> DataFrame:
    """Blobs (image_id, label, area, cx, cy, mean_val) of each image's own mask; ``tagged`` has (image_id, wavelength)."""
    if has_images(raster):
        own = tagged.select("image_id", F.when(
            F.col("wavelength").isin("red", "green"), F.col("wavelength")).otherwise(F.lit("")).alias("tag"))
        return image_blobs(raster).join(own, ["image_id", "tag"]).drop("tag")
    bgr = (F.col("b"), F.col("g"), F.col("r"))
    # Pixels of no colour at all do not move to the tags.
    mask = raster.filter(colour_mask(*bgr, F.lit(""))).join(tagged.select("image_id", "wavelength"), "image_id").filter(
        colour_mask(*bgr, F.col("wavelength"))).select("image_id", "x", "y", hsv(*bgr).val.alias("val"))
    return blobs(labelled_runs(mask, ["image_id"]), ["image_id"])


def detect(frames: DataFrame, raster: DataFrame, context: DataFrame) -> DataFrame:
    """Best blob per image: colour mask, area gate, brightness times line closeness.

    Only images with an accepted blob have a row.  Equal scores go to the blob
    met first in reading order.
    """
    known = frames.select("image_id", "dive_id").distinct().join(context, "dive_id", "left")
    facts = known.select(
        "image_id", "wavelength", "line_a", "line_b", "line_c", "is_line_confident")
    found = tagged_blobs(raster, facts).filter(area_plausible(F.col("area")))
    line_distance = perpendicular_distance(
        F.col("cx"), F.col("cy"), F.col("line_a"), F.col("line_b"), F.col("line_c"))
    scored = found.join(facts, "image_id").withColumn(
        "score", blob_score(F.col("mean_val"), line_distance, F.col("is_line_confident")))
    order = F.struct("score", (-F.col("label")).alias("label"))
    return scored.filter(F.col("score") > 0).groupBy("image_id").agg(
        F.max_by(F.struct("cx", "cy", "score"), order).alias("p")
    ).select(
        "image_id", F.col("p.cx").alias("pred_x"), F.col("p.cy").alias("pred_y"),
        F.least("p.score", F.lit(1.0)).alias("pred_confidence"))


def classical_predictions(
    frames: DataFrame, raster: DataFrame, wavelengths: DataFrame, lines: DataFrame
) -> DataFrame:
    """PREDICTIONS, one row per frame; no blob or no image gives null and 0."""
    found = detect(frames, raster, classical_context(wavelengths, lines))
    return frames.select("image_id").join(found, "image_id", "left").withColumn(
        "pred_confidence", F.coalesce("pred_confidence", F.lit(0.0)))


def _areas_in_pixels(centres: DataFrame, pixels: DataFrame, half: int) -> DataFrame:
    keys = ["image_id", "cx", "cy"]
    patch = centres.join(pixels, "image_id").filter(
        F.col("x").between(F.col("cx") - half, F.col("cx") + half)
        & F.col("y").between(F.col("cy") - half, F.col("cy") + half))
    size = patch.groupBy(*keys).agg(F.count(F.lit(1)).alias("patch_size"))
    mask = patch.filter(audit_mask(F.col("b"), F.col("g"), F.col("r"))).select(
        *keys, "x", "y", F.lit(0).alias("val"))
    runs = labelled_runs(mask, keys)
    under = runs.filter(
        (F.col("y") == F.col("cy")) & F.col("cx").between(F.col("x0"), F.col("x1"))).select(*keys, "label")
    area = runs.join(under, [*keys, "label"], "left_semi").groupBy(*keys).agg(
        F.sum("area").alias("blob_pixels"))
    return area.join(size, keys)


def blob_under_label(points: DataFrame, raster: DataFrame, half: int = PATCH_HALF) -> DataFrame:
    """Blob of the audit mask that holds the labelled pixel, within a patch.

    ``points`` has (dive_id, image_id, label_x, label_y), any number per image; each
    label is measured in the patch of its own rounded centre.  Off-blob labels and
    blobs above a quarter of the patch are dropped.
    """
    labelled = points.select(
        "dive_id", "image_id",
        F.rint("label_x").cast("long").alias("cx"), F.rint("label_y").cast("long").alias("cy"))
    keys = ["image_id", "cx", "cy"]
    centres = labelled.select(*keys).distinct()
    measured = blobs_at_centres(centres, raster, half) if has_images(raster) else _areas_in_pixels(centres, raster, half)
    return labelled.join(
        measured.filter(F.col("blob_pixels") <= F.lit(MAX_PATCH_FRACTION) * F.col("patch_size")), keys
    ).select(
        "dive_id", "image_id", equivalent_diameter(F.col("blob_pixels")).alias("blob_diameter_px"), "blob_pixels")


def size_audit(
    frames: DataFrame, wavelengths: DataFrame, raster: DataFrame,
    max_dives: int = 30, per_dive: int = 5, seed: int = 0,
) -> DataFrame:
    """AUDIT table over a two-stage sample of positives."""
    sample = two_stage_sample(frames, max_dives, per_dive, seed)
    # Only the sampled images are read on.
    chosen = keep_members(raster, sample, "image_id")
    return blob_under_label(sample, chosen).join(
        wavelengths.select("dive_id", "wavelength"), "dive_id", "left"
    ).select("dive_id", "image_id", "wavelength", "blob_diameter_px", "blob_pixels")


def chromaticity_table(pixels: DataFrame, scale: float = 255.0) -> DataFrame:
    share = chromaticity(F.col("b"), F.col("g"), F.col("r"), scale)
    return pixels.withColumn("_s", share).select(
        "image_id", "x", "y", *[F.col(f"_s.{k}").alias(f"share_{k}") for k in "rgb"])


def cell_features(
    photosites: DataFrame,
    black: Sequence[int] = (0, 0, 0, 0),
    pattern: str = "RGBG",
    sites: Sequence[tuple[int, int]] = ((0, 0), (0, 1), (1, 1), (1, 0)),
) -> DataFrame:
    """Green excess, red excess and green difference per 2x2 sensor cell.

    ``photosites`` has (image_id, x, y, value).  ``sites`` gives the (row,
    column) in the cell of each letter of ``pattern``, ``black`` its black level;
    the two greens count in reading order.
    """
    def level(i: int) -> Column:
        dy, dx = sites[i]
        here = (F.pmod("y", F.lit(2)) == dy) & (F.pmod("x", F.lit(2)) == dx)
        return F.max(F.when(here, F.greatest(F.col("value") - F.lit(black[i]), F.lit(0))))

    red, blue = pattern.index("R"), pattern.index("B")
    greens = sorted((i for i, k in enumerate(pattern) if k == "G"), key=lambda i: tuple(sites[i]))
    cells = photosites.groupBy(
        "image_id", F.floor(F.col("x") / 2).cast("long").alias("cell_x"),
        F.floor(F.col("y") / 2).cast("long").alias("cell_y"),
    ).agg(
        level(red).alias("_r"), level(blue).alias("_b"),
        level(greens[0]).alias("_g1"), level(greens[1]).alias("_g2"))
    mean = F.floor((F.col("_g1") + F.col("_g2")) / 2).cast("long")
    return cells.withColumn("_g", mean).select(
        "image_id", "cell_x", "cell_y",
        F.greatest(F.col("_g") - F.greatest("_r", "_b"), F.lit(0)).cast("long").alias("g_excess"),
        F.greatest(F.col("_r") - F.greatest("_g", "_b"), F.lit(0)).cast("long").alias("r_excess"),
        F.greatest(F.least(F.col("_g1") - F.col("_g2"), F.lit(32767)), F.lit(-32768))
        .cast("long").alias("g_diff"))


def upsample_cells(cells: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Each cell value on its 2x2 pixels, cut to the visible size."""
    offsets = F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (0, 1) for dx in (0, 1)])
    out = cells.withColumn("_o", F.explode(offsets)).select(
        "image_id", (F.col("cell_x") * 2 + F.col("_o.dx")).alias("x"),
        (F.col("cell_y") * 2 + F.col("_o.dy")).alias("y"),
        *[c for c in cells.columns if c not in ("image_id", "cell_x", "cell_y")])
    limits = []
    if width is not None:
        limits.append(F.col("x") < width)
    if height is not None:
        limits.append(F.col("y") < height)
    return out.filter(all_of(limits)) if limits else out
