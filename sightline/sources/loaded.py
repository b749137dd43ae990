"""A user's image loader as a Spark data source: ``load(path, checksum)`` over partitions of paths.

The wanted paths are a written table; each of its files is a partition of the source, so a lost executor loads
one file's paths again and nothing passes through the driver but file names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sightline.session import cut_lineage

Loader = Callable[[str, str], np.ndarray | None]

SCHEMA = "image_path string, image_checksum string, height int, width int, n_channels int, data binary"
_ARROW = pa.schema([
    ("image_path", pa.string()), ("image_checksum", pa.string()), ("height", pa.int32()), ("width", pa.int32()),
    ("n_channels", pa.int32()), ("data", pa.binary())])
# Decoded bytes that a task holds before it hands them to Spark; a larger image goes alone.
BATCH_BYTES = 32 << 20
# And images, since the objects around a tiny one outweigh its bytes.
BATCH_ROWS = 1 << 12


class PathFile(InputPartition):
    """One file of the table of wanted paths."""

    def __init__(self, uri: str) -> None:
        super().__init__(uri)


def _loaded(load: Loader, path: str, checksum: str) -> tuple:
    """The row of one image: unreadable ones (None or an operating system error) have null columns."""
    try:
        image = load(path, checksum)
    except OSError:
        image = None
    if image is None:
        return path, checksum, None, None, None, None
    grid = np.ascontiguousarray(image if image.ndim == 3 else image[:, :, None])
    if grid.dtype != np.uint8:
        raise TypeError(f"{path}: images are 8-bit, not {grid.dtype}")
    return path, checksum, *grid.shape, grid.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def load_rows(load: Loader, pairs: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Images of (path, checksum) pairs in batches of bounded bytes and rows."""
    rows, held = [], 0
    for path, checksum in pairs:
        row = _loaded(load, path, checksum)
        size = len(row[-1] or b"")
        if rows and (held + size > BATCH_BYTES or len(rows) == BATCH_ROWS):
            yield _batch(rows)
            rows, held = [], 0
        rows.append(row)
        held += size
    if rows:
        yield _batch(rows)


class _Reader(DataSourceReader):
    def __init__(self, load: Loader, files: list[str]) -> None:
        self.load, self.files = load, files

    def partitions(self) -> list[InputPartition]:
        return [PathFile(f) for f in self.files]

    def read(self, partition: PathFile) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.value)

        def pairs() -> Iterator[tuple[str, str]]:
            with system.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(1024, columns=["image_path", "image_checksum"]):
                    yield from zip(*(c.to_pylist() for c in batch.columns))

        return load_rows(self.load, pairs())


def image_source(load: Loader) -> type[DataSource]:
    """A data source class around a loader; its option ``files`` lists the files of (image_path, image_checksum)."""
    source = f"loaded_images_{uuid.uuid4().hex}"

    class LoadedImages(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(load, [f for f in self.options["files"].split("\n") if f])

    return LoadedImages


def load_images(wanted: DataFrame, load: Loader, partitions: int | None = None) -> DataFrame:
    """(image_path, image_checksum, height, width, n_channels, data) of the distinct wanted images.

    ``load`` returns an 8-bit array of (height, width) or (height, width, channels), or None; a missing or
    unreadable image keeps its row with nulls.  Null paths are not loaded and have no row.  Runs a job that
    writes the wanted paths to the checkpoint folder, in ``partitions`` files (default: those of the session's
    shuffle): about as many images as should be lost with a task.
    """
    spark = wanted.sparkSession
    pairs = wanted.filter(F.col("image_path").isNotNull()).select("image_path", "image_checksum").distinct()
    pairs = pairs.repartition(partitions, "image_path") if partitions else pairs.repartition("image_path")
    files = cut_lineage(pairs).inputFiles()
    source = image_source(load)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("files", "\n".join(files)).load()
