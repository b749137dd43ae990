"""Images as tables: scan, decoded store, pixel rows."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.functions.pixel_arrays import grid_of
from sightline.operators.frames import keep_members
from sightline.operators.ordering import attach_scalars
from sightline.schemas import MANIFEST, PIXELS, STORED
from sightline.session import cut_lineage
from sightline.sources.loaded import Loader, load_images
from sightline.sources.tables import path_exists

# Pixels turned into rows at a time; bounds a task's memory.
PIXELS_PER_BLOCK = 1 << 18


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images under ``root`` with their relative ``image_path`` (BGR bytes)."""
    raw = spark.read.format("image").option("dropInvalid", True).option(
        "recursiveFileLookup", True).load(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    # ``file:/a`` and ``file:///a`` name the same folder; an authority stays.
    base = re.sub(r"^file:/+", "file:/", full).rstrip("/") + "/"
    origin = F.regexp_replace(F.col("image.origin"), r"^file:/+", "file:/")
    outside = F.raise_error(F.concat(F.lit(f"not below {base}: "), F.col("image.origin")))
    return raw.select(
        F.when(origin.startswith(base), F.substring(origin, len(base) + 1, 1 << 16)).otherwise(outside).alias("image_path"),
        F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def attach_images(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Every frame with its image; a missing or unreadable one is null."""
    return frames.join(images, "image_path", "left")


def null_images(frames: DataFrame) -> DataFrame:
    """Frames without any image, as when only label-based steps are wanted."""
    return frames.select(
        "*", F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("n_channels"), F.lit(None).cast("binary").alias("data"))


def _checked(frames: DataFrame) -> DataFrame:
    empty = F.col("image_checksum").isNull() | (F.col("image_checksum") == "")
    return frames.withColumn("image_checksum", F.when(
        empty, F.raise_error(F.lit("an image without checksum cannot be stored"))
    ).otherwise(F.col("image_checksum")))


@dataclass(frozen=True)
class ImageStore:
    """Decoded images under ``path``, with a manifest that says what is there.

    ``images`` has (image_checksum, height, width, n_channels, data) in folders by run and first two characters
    of the checksum; ``manifest`` has a row per tried image of each run that ended (checksum, path, status,
    size).  A run that died left images without manifest rows: they are not read, and the next run decodes
    them again.  ``fmt`` is the format of the images.
    """

    spark: SparkSession
    path: str
    fmt: str = "parquet"

    def manifest(self) -> DataFrame:
        where = f"{self.path}/manifest"
        if not path_exists(self.spark, where):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(where)

    def present(self) -> DataFrame:
        """Checksums that are stored, with the run that stored them (one each)."""
        return self.manifest().filter(F.col("status") == "decoded").groupBy("image_checksum").agg(F.min("run").alias("run"))

    def images(self, checksums: DataFrame | None = None) -> DataFrame:
        """The stored images, or those of ``checksums``: folders of runs that did not end are pruned."""
        present = self.present()
        if checksums is not None:
            present = present.join(checksums.select("image_checksum").distinct(), "image_checksum", "left_semi")
        if not path_exists(self.spark, f"{self.path}/images"):
            return self.spark.createDataFrame([], STORED)
        stored = self.spark.read.format(self.fmt).schema(
            "image_checksum string, height int, width int, n_channels int, data binary, run string, prefix string"
        ).load(f"{self.path}/images")
        return stored.join(present, ["image_checksum", "run"]).select(*[f.name for f in STORED.fields])

    def add(self, images: DataFrame, run: str) -> DataFrame:
        """Write the images of one run and then its manifest rows, which are returned (runs two jobs).

        ``images`` has (image_path, image_checksum, height, width, n_channels, data); of several rows of one
        checksum that were read, the first by path counts.  Writing the same run again replaces it.
        """
        rows = images.select(*STORED.fieldNames(), "image_path", F.substring("image_checksum", 1, 2).alias("prefix"))
        staged = f"{self.path}/images/run={run}"
        rows.write.mode("overwrite").partitionBy("prefix").format(self.fmt).save(staged)
        # Sizes and states come from the written table's narrow columns; no image is read again.
        tried = self.spark.read.format(self.fmt).schema(
            "image_checksum string, height int, width int, n_channels int, image_path string").load(staged)
        noted = tried.select(
            "image_checksum", "image_path", F.when(F.col("height").isNotNull(), "decoded").otherwise("failed").alias("status"),
            "height", "width", "n_channels", F.lit(run).alias("run"))
        noted.write.mode("overwrite").parquet(f"{self.path}/manifest/part={run}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/part={run}")


def warm_store(frames: DataFrame, store: ImageStore, load: Loader, run: str | None = None, retry_failed: bool = True) -> DataFrame:
    """Decode what the store lacks and report per wanted image: (image_checksum, status, attempts).

    ``status`` is warm, decoded or failed; ``attempts`` counts calls of the loader in this run.  What is there
    already is known from the manifest before any byte is read, so a second run calls the loader for failed
    images only, or not at all without ``retry_failed``.  Of several paths of one checksum the first is loaded,
    the others only if it fails.  Runs jobs; the report is read from the manifest's columns.
    """
    run = run or uuid.uuid4().hex
    wanted = cut_lineage(_checked(frames).groupBy("image_checksum").agg(
        F.array_sort(F.collect_set("image_path")).alias("paths")))
    present = store.present().select("image_checksum", F.lit(True).alias("_warm"))
    known = wanted.join(present, "image_checksum", "left")
    todo = known.filter(F.col("_warm").isNull()).select("image_checksum", "paths")
    if not retry_failed:
        failed = store.manifest().filter(F.col("status") == "failed").select("image_checksum").distinct()
        todo = todo.join(failed, "image_checksum", "left_anti")
    todo = cut_lineage(todo)
    # The state before this run decides what was warm.
    warm = cut_lineage(known.filter(F.col("_warm")).select("image_checksum"))
    attempt = 0
    left = todo.filter(F.size("paths") > 0)
    while not left.isEmpty():
        here = left.select("image_checksum", F.get("paths", F.lit(attempt)).alias("image_path"))
        store.add(load_images(here, load), f"{run}-{attempt}")
        attempt += 1
        left = todo.filter(F.size("paths") > attempt).join(store.present(), "image_checksum", "left_anti")
    tried = store.manifest().filter(F.col("run").startswith(f"{run}-")).groupBy("image_checksum").agg(
        F.max((F.col("status") == "decoded").cast("int")).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return wanted.select("image_checksum").join(
        warm.withColumn("_warm", F.lit(True)), "image_checksum", "left").join(tried, "image_checksum", "left").select(
        "image_checksum",
        F.when(F.col("_warm"), "warm").when(F.col("_ok") == 1, "decoded").otherwise("failed").alias("status"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("attempts"))


def warm_report(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


def warm_split(
    frames: DataFrame, splits: DataFrame, split: str, store: ImageStore, load: Loader, retry_failed: bool = True
) -> DataFrame:
    """Warm the store for one split's frames and count the outcomes."""
    chosen = keep_members(frames, splits.filter(F.col("split") == split), "dive_id")
    return warm_report(warm_store(chosen, store, load, retry_failed=retry_failed))


def reencode_store(source: ImageStore, target: ImageStore, run: str | None = None) -> DataFrame:
    """Rewrite a decoded store in the format of ``target``, skipping what that has.

    One row: done, skipped and failed (rows whose bytes do not fit their size).  The bytes of the images to
    do are read once, and only theirs; the counts come from manifests.
    """
    run = run or uuid.uuid4().hex
    there = target.present().select("image_checksum")
    # Counted before the target grows.
    counts = cut_lineage(source.present().select("image_checksum").join(
        there.withColumn("_there", F.lit(True)), "image_checksum", "left").agg(F.count_if(F.col("_there")).alias("skipped")))
    todo = cut_lineage(source.present().select("image_checksum").join(there, "image_checksum", "left_anti"))
    fits = F.length("data") == F.col("height") * F.col("width") * F.col("n_channels")
    rows = source.images(todo).select(
        F.lit(None).cast("string").alias("image_path"), "image_checksum",
        *[F.when(fits, F.col(c)).alias(c) for c in ("height", "width", "n_channels", "data")])
    noted = target.add(rows, run)
    done = noted.agg(
        F.count_if(F.col("status") == "decoded").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    return attach_scalars(done, counts).select("done", "skipped", "failed")


def pixel_table(images: DataFrame) -> DataFrame:
    """PIXELS rows of (image_id, height, width, n_channels, data); null images have none.

    For sparse masks and small rasters; whole photographs stay images (``operators.image_blocks``).  Images of
    one size are turned together, large ones in blocks of rows.  Frames are large: set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` to a few rows for 4K images.
    """
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = defaultdict(list)
            for i, shape in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width", "n_channels")))):
                shapes[shape].append(i)
            ids = batch.column("image_id").to_numpy()
            for (h, w, n), rows in shapes.items():
                step = max(1, PIXELS_PER_BLOCK // max(1, h * w))
                for at in range(0, len(rows), step):
                    chosen = rows[at:at + step]
                    grids = np.stack([grid_of(batch.column("data")[i].as_py(), h, w, n) for i in chosen])
                    high = max(1, PIXELS_PER_BLOCK // max(1, w * len(chosen)))
                    for top in range(0, h, high):
                        block = grids[:, top:top + high]
                        image, y, x = (a.ravel() for a in np.indices(block.shape[:3]))
                        columns = (ids[chosen][image], x, y + top, *block.reshape(-1, 3).T.astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIXELS.names)

    usable = images.filter(F.col("data").isNotNull()).select(
        "image_id", "height", "width", "n_channels", "data")
    return usable.mapInArrow(expand, PIXELS)
