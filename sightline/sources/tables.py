"""Table scans and sinks with declared schemas."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sightline import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system the session resolves it to."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan under a declared schema; filters and columns reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table, or None where it does not exist."""
    return read_table(spark, path, schema) if path_exists(spark, path) else None


def read_or_compute(
    spark: SparkSession,
    path: str,
    compute: Callable[[], DataFrame],
    schema: T.StructType | None = None,
    force: bool = False,
) -> DataFrame:
    """Reuse a finished artefact, else compute, write and read it back.

    A table counts as finished once its commit marker is there.  Reading back
    cuts the lineage and gives Catalyst the file sizes for join planning.
    """
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        write_table(compute(), path)
    return read_table(spark, path, schema)


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame | None:
    """Camera intrinsics per rig; None (rectification is then skipped) if absent."""
    return read_optional(spark, path, schemas.RIG_INTRINSICS)


def read_flips(spark: SparkSession, path: str) -> DataFrame | None:
    return read_optional(spark, path, schemas.ORF_FLIP)


def flips_by_checksum(headers: DataFrame) -> DataFrame:
    """ORF_FLIP from landed header rows (image_checksum, flip): one per checksum.

    Unreadable headers have a null flip; a readable duplicate wins over them.
    """
    return headers.groupBy("image_checksum").agg(F.max("flip").cast("int").alias("flip"))


def replace_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Write ``df`` in place of the partitions that it has rows for; all others stay.

    A repeated job thus leaves one copy of its rows, and jobs of other partitions do not meet.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def log_metrics(
    metrics: DataFrame, path: str, run_id: str, step: int = 0
) -> None:
    """Put (slice, metric, value) rows of one run and step into the METRICS table, in place of earlier ones."""
    rows = metrics.select(
        "slice", "metric", F.col("value").cast("double").alias("value"),
        F.lit(run_id).alias("run_id"), F.lit(step).cast("long").alias("step"))
    replace_partitions(rows, path, ("run_id", "step"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The METRICS table; a condition on run and step prunes its folders."""
    return read_table(spark, path, schemas.METRICS).select(*schemas.METRICS.fieldNames())


def log_run(spark: SparkSession, path: str, settings: Mapping[str, object], run_id: str | None = None) -> str:
    """Put the settings and tags of a run into the RUNS table, in place of earlier ones; returns its id."""
    run_id = run_id or uuid.uuid4().hex
    rows = [(run_id, str(k), str(v)) for k, v in settings.items()]
    replace_partitions(spark.createDataFrame(rows, schemas.RUNS), path, ("run_id",))
    return run_id


def parse_records(
    raw: DataFrame, payload: str, fields: Mapping[str, str], required: Sequence[str] = ()
) -> DataFrame:
    """Columns of a JSON payload as declared types, and ``problem`` for records that do not fit.

    Nothing fails: the payload is read permissively as text fields, which are cast with ``try_cast``.
    ``problem`` is null for good records, else ``unreadable`` (no JSON object), ``missing:<field>`` for a
    required field that is absent or null, or ``malformed:<field>`` for a value that its type cannot hold; of
    several the first.  Other columns of ``raw`` are kept.
    """
    schema = T.StructType([*[T.StructField(name, T.StringType()) for name in fields], T.StructField("_bad", T.StringType())])
    parsed = raw.withColumn("_p", F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    values = {name: F.col(f"_p.{name}").try_cast(kind) for name, kind in fields.items()}
    problem = F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), "unreadable")
    for name in fields:
        given = F.col(f"_p.{name}").isNotNull()
        if name in required:
            problem = problem.when(~given, f"missing:{name}")
        problem = problem.when(given & values[name].isNull(), f"malformed:{name}")
    kept = [c for c in raw.columns if c != payload and c not in fields]
    return parsed.select(*kept, *[v.alias(name) for name, v in values.items()], problem.alias("problem"))


def failed_keys(records: DataFrame, key: str) -> DataFrame:
    """Sources with a bad record: key, number of bad records and the least problem among them."""
    return records.filter(F.col("problem").isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_bad"), F.min("problem").alias("problem"))
