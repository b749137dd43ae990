"""One Arrow pass over images: patches, blobs and crops leave it, never whole pixel tables.

Images are rows (image_id, height, width, n_channels, data).  Very large ones can come in strips: rows with
``top``, the raster row at which the strip begins.  A strip is labelled by itself, and only blobs that reach
its first or last row are linked across strips.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sightline.functions.pixel_arrays import (
    audit_mask_array, grid_of, labelled_runs_of, linked_runs, run_sums, tag_masks)
from sightline.session import cut_lineage

# Pixels of equally large images that are labelled at a time.
PIXELS_AT_ONCE = 1 << 21
# Bytes of crops that leave the worker together.
CROP_BYTES = 16 << 20
# A run is named by its row and first column, both 32-bit in every image format that is read.
ROW_STEP = 1 << 31
# Raster rows whose runs are linked together in one task.
BAND_ROWS = 64

_LONGS = ("image_id", "cx", "cy", "x", "y", "b", "g", "r")
_EDGE = T.StructType([T.StructField(c, T.LongType()) for c in ("y", "x0", "x1")])
_PARTS = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("tag", T.StringType()),
    *[T.StructField(c, T.LongType()) for c in ("node", "area", "sum_x", "sum_y", "sum_val")],
    T.StructField("edge", T.ArrayType(_EDGE))])
_EDGES = pa.list_(pa.struct([(c, pa.int64()) for c in ("y", "x0", "x1")]))


def has_images(raster: DataFrame) -> bool:
    """Whether a raster argument holds images (a row each) or the pixel rows of PIXELS."""
    return "data" in raster.columns


def with_centres(points: DataFrame, images: DataFrame) -> DataFrame:
    """Images that hold points, with the distinct centres of their patches as one array.

    ``points`` has (image_id, cx, cy).  The image side is only pruned; its bytes move if the points are too
    many to be broadcast, so load images by path after this join where that is possible.
    """
    centres = points.select("image_id", "cx", "cy").distinct().groupBy("image_id").agg(
        F.collect_list(F.struct("cx", "cy")).alias("_centres"))
    usable = images.filter(F.col("data").isNotNull()).select("image_id", "height", "width", "n_channels", "data")
    return usable.join(centres, "image_id")


def _patches(batch: pa.RecordBatch, half: int) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(image_id, cx, cy, left, top, patch) of every centre that is in reach of its image."""
    for row in batch.to_pylist():
        grid = grid_of(row["data"], row["height"], row["width"], row["n_channels"])
        for centre in row["_centres"]:
            cx, cy = centre["cx"], centre["cy"]
            if cx is None or cy is None:
                continue
            left, top = max(cx - half, 0), max(cy - half, 0)
            patch = grid[top:max(cy + half + 1, 0), left:max(cx + half + 1, 0)]
            if patch.size:
                yield row["image_id"], cx, cy, left, top, patch


def patch_pixels(points: DataFrame, images: DataFrame, half: int) -> DataFrame:
    """Pixel rows (image_id, cx, cy, x, y, b, g, r) of the patches around the centres, cut at the image's edges."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in _LONGS]
            for image_id, cx, cy, left, top, patch in _patches(batch, half):
                h, w, _ = patch.shape
                y, x = np.mgrid[top:top + h, left:left + w]
                flat = patch.reshape(-1, 3).astype(np.int64)
                values = (np.full(h * w, image_id), np.full(h * w, cx), np.full(h * w, cy), x.ravel(), y.ravel(), *flat.T)
                for held, v in zip(columns, values):
                    held.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns], list(_LONGS))

    return with_centres(points, images).mapInArrow(cut, ", ".join(f"{c} long" for c in _LONGS))


def blobs_at_centres(points: DataFrame, images: DataFrame, half: int) -> DataFrame:
    """(image_id, cx, cy, blob_pixels, patch_size): the audit blob that holds the centre, within its patch.

    Centres outside their image or off any blob have no row.
    """
    names = ("image_id", "cx", "cy", "blob_pixels", "patch_size")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = defaultdict(list)
            for patch in _patches(batch, half):
                shapes[patch[-1].shape].append(patch)
            rows: list[tuple[int, ...]] = []
            for (h, w, _), held in shapes.items():
                step = max(1, PIXELS_AT_ONCE // (h * w))
                for at in range(0, len(held), step):
                    rows += _areas_at(held[at:at + step], h, w)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], list(names))

    return with_centres(points, images).mapInArrow(measure, ", ".join(f"{c} long" for c in names))


def _areas_at(patches: list, height: int, width: int) -> Iterator[tuple[int, ...]]:
    runs = labelled_runs_of(audit_mask_array(np.stack([p[-1] for p in patches])))
    area = np.bincount(runs.label, runs.length, minlength=len(runs)).astype(np.int64) if len(runs) else np.zeros(0, np.int64)
    own_x = np.array([p[1] - p[3] for p in patches])
    own_y = np.array([p[2] - p[4] for p in patches])
    hit = np.flatnonzero((runs.y == own_y[runs.image]) & (runs.x0 <= own_x[runs.image]) & (runs.x1 >= own_x[runs.image]))
    for i in hit.tolist():
        image_id, cx, cy = patches[runs.image[i]][:3]
        yield image_id, cx, cy, int(area[runs.label[i]]), height * width


def blob_parts(images: DataFrame) -> DataFrame:
    """Blobs of every detector mask of each image or strip: (image_id, tag, node, area, sum_x, sum_y, sum_val, edge).

    ``tag`` names the mask (red, green, or empty for both), so the bytes need no join with the tags.  ``node``
    is the blob's first run; ``edge`` has its runs on the outer rows of a strip and is null for whole images.
    """
    strips = "top" in images.columns
    usable = images.filter(F.col("data").isNotNull()).select(
        "image_id", "height", "width", "n_channels", "data",
        (F.col("top") if strips else F.lit(0)).cast("long").alias("top"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = defaultdict(list)
            for i, shape in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width", "n_channels")))):
                shapes[shape].append(i)
            ids, tops = batch.column("image_id").to_numpy(), batch.column("top").to_numpy()
            for (h, w, n), rows in shapes.items():
                step = max(1, PIXELS_AT_ONCE // max(1, h * w))
                for at in range(0, len(rows), step):
                    chosen = rows[at:at + step]
                    grids = np.stack([grid_of(batch.column("data")[i].as_py(), h, w, n) for i in chosen])
                    masks, val = tag_masks(grids)
                    for tag, mask in masks.items():
                        yield _parts(labelled_runs_of(mask), val, tag, ids[chosen], tops[chosen], h if strips else None)

    return usable.mapInArrow(label, _PARTS)


def _parts(runs, val: np.ndarray, tag: str, ids: np.ndarray, tops: np.ndarray, strip_height: int | None) -> pa.RecordBatch:
    first = np.flatnonzero(runs.label == np.arange(len(runs)))
    blob = np.searchsorted(first, runs.label)
    y = runs.y + tops[runs.image]

    def total(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(first), dtype=np.int64)
        np.add.at(out, blob, values)
        return pa.array(out)

    edges = pa.nulls(len(first), _EDGES)
    if strip_height is not None:
        held: list[list[dict[str, int]]] = [[] for _ in first]
        for i in np.flatnonzero((runs.y == 0) | (runs.y == strip_height - 1)).tolist():
            held[blob[i]].append({"y": int(y[i]), "x0": int(runs.x0[i]), "x1": int(runs.x1[i])})
        edges = pa.array(held, _EDGES)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[runs.image[first]], pa.int64()), pa.array([tag] * len(first), pa.string()),
         pa.array(y[first].astype(np.int64) * ROW_STEP + runs.x0[first]), total(runs.length),
         total((runs.x0 + runs.x1) * runs.length // 2), total(y * runs.length), total(run_sums(val, runs)), edges],
        _PARTS.names)


def local_labels(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs (keys, node, y, x0, x1) with ``local``, the least node of their component inside their band of rows.

    One Arrow pass over runs dealt and sorted by band; a task holds one band, or a batch of small ones.
    """
    group = [*keys, "_band"]
    dealt = runs.withColumn("_band", F.floor(F.col("y") / BAND_ROWS)).repartition(*group).sortWithinPartitions(*group, "y", "x0")

    def labelled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
        number = np.concatenate([[0], np.cumsum(_changes(batch))])
        local = linked_runs(number, *(batch.column(c).to_numpy() for c in ("node", "y", "x0", "x1")))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], [*batch.schema.names, "local"])

    def _changes(batch: pa.RecordBatch) -> np.ndarray:
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in group:
            column = batch.column(c)
            changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return changed

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(batch.column(c)[0] != held[-1].column(c)[-1] for c in group):
                yield labelled(held)
                held = []
            starts = np.flatnonzero(_changes(batch)) + 1
            if len(starts):
                last = int(starts[-1])
                yield labelled([*held, batch.slice(0, last)])
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield labelled(held)

    return dealt.mapInArrow(label, T.StructType([*dealt.schema.fields, T.StructField("local", T.LongType())])).drop("_band")


def across_bands(local: DataFrame, links: DataFrame, keys: Sequence[str], touching, labels_of) -> DataFrame:
    """``local`` (written) with ``label``: components go on over the bands' outer rows, in rounds over these alone.

    ``links`` has further pairs (u, v) of local labels that belong together.
    """
    row = F.pmod("y", F.lit(BAND_ROWS))
    outer = local.filter(((row == 0) & (F.col("y") != 0)) | (row == BAND_ROWS - 1)).select(
        *keys, "y", "x0", "x1", F.col("local").alias("node"))
    pairs = cut_lineage(touching(outer, keys).unionByName(links).filter(F.col("u") != F.col("v")).distinct())
    if pairs.isEmpty():
        return local.withColumn("label", F.col("local"))
    nodes = pairs.select(*keys, F.col("u").alias("node")).unionByName(pairs.select(*keys, F.col("v").alias("node"))).distinct()
    labels = labels_of(nodes, pairs, keys).withColumnRenamed("node", "local")
    return local.join(labels, [*keys, "local"], "left").withColumn("label", F.coalesce("label", "local"))


def linked_parts(parts: DataFrame, keys: Sequence[str], touching, labels_of) -> DataFrame:
    """Blobs across strips: parts with the label of their blob (its least node).

    Only the runs on the strips' outer rows are compared: band by band, and then from band to band in rounds
    (``touching``, ``labels_of``); all other parts are whole already.
    """
    border = parts.filter(F.size("edge") > 0).select(*keys, "node", F.explode("edge").alias("_e")).select(
        *keys, "node", "_e.*")
    local = cut_lineage(local_labels(border.dropna(subset=[*keys]), keys))
    # A part lies in two bands at most, since its runs here are on two rows.
    seen = local.groupBy(*keys, "node").agg(F.min("local").alias("u"), F.max("local").alias("v"))
    labelled = across_bands(local, seen.filter(F.col("u") != F.col("v")).select(*keys, "u", "v"), keys, touching, labels_of)
    labels = labelled.groupBy(*keys, "node").agg(F.min("label").alias("label"))
    return parts.join(labels, [*keys, "node"], "left").withColumn("label", F.coalesce("label", "node"))


def tile_crops(tiles: DataFrame, images: DataFrame, tile: int) -> DataFrame:
    """Tile rows with ``crop``: tile x tile blue, green and red bytes from (crop_x, crop_y) of their image.

    Images smaller than a tile are continued at the right and the bottom by reflection without repeating the
    edge.  Tiles whose image is missing or unreadable are left out.  The crops of an image are cut while its
    bytes are at hand, one pass over the images.
    """
    wanted = tiles.groupBy("image_id").agg(F.collect_list(F.struct(*tiles.columns)).alias("_tiles"))
    usable = images.filter(F.col("data").isNotNull()).select("image_id", "height", "width", "n_channels", "data")
    row = T.StructType(tiles.schema.fields)
    schema = T.StructType([T.StructField("tile", row), T.StructField("crop", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_tiles")
            sizes = np.diff(lists.offsets.to_numpy())
            origins = [lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("crop_x", "crop_y")]
            at, crops, held, start = 0, [], 0, 0
            for i, n in enumerate(sizes.tolist()):
                shape = [batch.column(c)[i].as_py() for c in ("height", "width", "n_channels")]
                grid = grid_of(batch.column("data")[i].as_py(), *shape)
                pad = [(0, max(tile - side, 0)) for side in grid.shape[:2]]
                if any(p[1] for p in pad):
                    grid = np.pad(grid, (*pad, (0, 0)), mode="reflect" if min(grid.shape[:2]) > 1 else "edge")
                for _ in range(n):
                    x, y = int(origins[0][at]), int(origins[1][at])
                    crops.append(grid[y:y + tile, x:x + tile].tobytes())
                    held, at = held + len(crops[-1]), at + 1
                    if held > CROP_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [lists.flatten().slice(start, at - start), pa.array(crops, pa.binary())], ["tile", "crop"])
                        crops, held, start = [], 0, at
            yield pa.RecordBatch.from_arrays(
                [lists.flatten().slice(start, at - start), pa.array(crops, pa.binary())], ["tile", "crop"])

    return usable.join(wanted, "image_id").mapInArrow(cut, schema).select("tile.*", "crop")
