"""Session settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "sightline-"

# Adaptive execution picks broadcast joins from measured sizes, coalesces small
# partitions and splits skewed join partitions (also in front of aggregates).
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites in error messages cost a stack walk per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`RECOMMENDED_CONF` to a session builder."""
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` (or ``setCheckpointDir``) names; it must be set.

    Nothing is guessed: on a cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


# Where cut_lineage notes the tables it writes, if anyone collects them.
_collecting: ContextVar[list[str] | None] = ContextVar("_collecting", default=None)


@contextmanager
def collect_written(paths: list[str]) -> Iterator[list[str]]:
    """Note the tables that :func:`cut_lineage` writes inside the block, for :func:`release_paths`."""
    token = _collecting.set(paths)
    try:
        yield paths
    finally:
        _collecting.reset(token)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back (runs a job).

    A columnar table instead of ``DataFrame.checkpoint``: later reads prune
    columns, and its file size lets Catalyst choose joins.  The files stay until
    they are released or the folder is cleaned, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{_PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    noted = _collecting.get()
    if noted is not None:
        noted.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_paths(spark: SparkSession, paths: list[str], still_read: DataFrame | None = None) -> None:
    """Delete tables that :func:`cut_lineage` wrote, but for those that ``still_read`` reads; empties ``paths`` of them."""
    used = still_read.inputFiles() if still_read is not None and paths else []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in list(paths):
        name = path.rsplit("/", 1)[1]
        if name.startswith(_PREFIX) and not any(name in f for f in used):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            paths.remove(path)


def release(written: DataFrame) -> None:
    """Delete the table behind a result of :func:`cut_lineage`, once nothing reads it any more."""
    folders = {f.rsplit("/", 1)[0] for f in written.inputFiles()}
    if len(folders) == 1:
        release_paths(written.sparkSession, [*folders])
