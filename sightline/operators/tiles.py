"""Tile grids, training crops and sparse targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.hashing import uniform
from sightline.functions.labels import colour_value

# Fixed values.
TILE = 1024
OVERLAP = 256
TARGET_SIGMA_PX = 3.0
CENTRE_PROBABILITY = 0.70
EDGE_PAD_PX = 64


def _axis_origins(size: Column, tile: int, overlap: int) -> Column:
    """Origins along one axis; the last tile ends at the edge."""
    last = (size - F.lit(tile)).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(last - 1, F.lit(0)), F.lit(tile - overlap).cast("long"))
    return F.when(size <= tile, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_append(steps, last))


def tile_grid(images: DataFrame, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """Tiles in reading order: (tile_idx, tile_x, tile_y, padded_h, padded_w) per image.

    ``images`` has (height, width); an axis shorter than a tile is one padded tile.
    """
    xs, ys = _axis_origins(F.col("width"), tile, overlap), _axis_origins(F.col("height"), tile, overlap)
    origins = F.flatten(F.transform(ys, lambda y: F.transform(
        xs, lambda x: F.struct(x.alias("tile_x"), y.alias("tile_y")))))
    return images.select(
        "*",
        F.greatest("height", F.lit(tile)).alias("padded_h"),
        F.greatest("width", F.lit(tile)).alias("padded_w"),
        F.posexplode(origins).alias("tile_idx", "_origin"),
    ).select("*", "_origin.tile_x", "_origin.tile_y").drop("_origin")


def tiles_holding_labels(records: DataFrame, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """(image_id, tile_idx) of every tile that contains the record's label.

    The tiles of an image follow from its size, so the range test needs no join.
    """
    x, y = F.col("label_x"), F.col("label_y")
    return tile_grid(records.filter(x.isNotNull() & y.isNotNull()), tile, overlap).filter(
        (x >= F.col("tile_x")) & (x < F.col("tile_x") + tile)
        & (y >= F.col("tile_y")) & (y < F.col("tile_y") + tile))


def tiles_meeting_line(tiles: DataFrame, band_px: float, tile: int = TILE) -> DataFrame:
    """Tiles that the band around the dive line crosses; all tiles without a line.

    A box meets the band if its corners lie on both sides of the line or the
    nearest one within the band; signed distance is monotone in each coordinate.
    """
    a, b, c = F.col("line_a"), F.col("line_b"), F.col("line_c")
    corners = [
        a * (F.col("tile_x") + dx) + b * (F.col("tile_y") + dy) + c
        for dx in (0, tile - 1) for dy in (0, tile - 1)]
    low, high = F.least(*corners), F.greatest(*corners)
    return tiles.filter(a.isNull() | ((low <= band_px) & (high >= -band_px)))


def crop_origin(
    records: DataFrame,
    tile: int = TILE,
    edge_pad: int = EDGE_PAD_PX,
    centre_p: float = CENTRE_PROBABILITY,
    seed: object = 0,
) -> DataFrame:
    """Add (crop_x, crop_y): biased to hold the label, else uniform.

    With probability ``centre_p`` a labelled record is cropped so that its label
    keeps ``edge_pad`` from the crop edges, as far as the image allows.
    """
    biased = F.col("label_x").isNotNull() & (uniform(f"{seed}/b", "image_id") < F.lit(centre_p))

    def axis(label: str, size: str, salt: str) -> Column:
        room = F.greatest(F.col(size) - F.lit(tile), F.lit(0)).cast("long")
        at = F.col(label)
        low = F.greatest(F.ceil(at - F.lit(tile - edge_pad)), F.lit(0))
        high = F.least(F.floor(at - F.lit(edge_pad)), room)
        centred = F.greatest(F.lit(0), F.least(at.cast("long") - F.lit(tile // 2), room))
        low_b = F.when(low > high, centred).otherwise(low)
        high_b = F.when(low > high, centred).otherwise(high)
        lo = F.when(biased, low_b).otherwise(F.lit(0))
        hi = F.when(biased, high_b).otherwise(room)
        u = uniform(f"{seed}/{salt}", "image_id")
        return (lo + F.least(F.floor(u * (hi - lo + 1)), hi - lo)).cast("long")

    return records.withColumn("crop_x", axis("label_x", "width", "x")).withColumn(
        "crop_y", axis("label_y", "height", "y"))


def _target_range(at: Column, size: int, sigma: float) -> tuple[Column, Column]:
    radius = int(-(-3.0 * sigma // 1))
    low = F.greatest(F.floor(at) - F.lit(radius), F.lit(0))
    high = F.least(F.ceil(at) + F.lit(radius), F.lit(size - 1))
    return low.cast("long"), high.cast("long")


def gaussian_target(
    points: DataFrame, height: int, width: int, sigma: float = TARGET_SIGMA_PX,
    x: str = "local_x", y: str = "local_y",
) -> DataFrame:
    """Non-zero target cells (tx, ty, target) within three sigma of the point.

    Points outside the raster have none.  The patch size depends on sigma only.
    """
    px, py = F.col(x), F.col(y)
    inside = points.filter((px >= 0) & (px < width) & (py >= 0) & (py < height))
    x0, x1 = _target_range(px, width, sigma)
    y0, y1 = _target_range(py, height, sigma)
    cells = inside.withColumn("ty", F.explode(F.sequence(y0, y1))).withColumn(
        "tx", F.explode(F.sequence(x0, x1)))
    dx, dy = F.col("tx") - px, F.col("ty") - py
    return cells.withColumn(
        "target", F.exp(-(dx * dx + dy * dy) / F.lit(2.0 * sigma * sigma)))


def training_tiles(
    records: DataFrame,
    available: DataFrame | None = None,
    tile: int = TILE,
    edge_pad: int = EDGE_PAD_PX,
    centre_p: float = CENTRE_PROBABILITY,
    seed: object = 0,
) -> DataFrame:
    """One crop per record: origin, local label, presence, colour value, line fields.

    Records whose image is not in ``available`` are skipped.  Without a line
    the placeholder (0, 0, 1) is given; the confidence flag gates it out.
    """
    rows = records if available is None else records.join(
        available.select("image_id").distinct(), "image_id", "left_semi")
    padded = rows.withColumn("height", F.greatest("height", F.lit(tile))).withColumn(
        "width", F.greatest("width", F.lit(tile)))
    cropped = crop_origin(padded, tile, edge_pad, centre_p, seed)
    local_x, local_y = F.col("label_x") - F.col("crop_x"), F.col("label_y") - F.col("crop_y")
    present = (local_x >= 0) & (local_x < tile) & (local_y >= 0) & (local_y < tile)
    has_line = F.col("line_a").isNotNull()

    def line_field(name: str, default: float) -> Column:
        return F.when(has_line, F.col(name)).otherwise(F.lit(default)).alias(name)

    return cropped.select(
        "dive_id", "image_id", "crop_x", "crop_y",
        local_x.alias("local_x"), local_y.alias("local_y"),
        F.coalesce(present, F.lit(False)).alias("presence"),
        colour_value(F.col("wavelength")).alias("colour_value"),
        line_field("line_a", 0.0), line_field("line_b", 0.0), line_field("line_c", 1.0),
        "line_confidence", "is_line_confident")
