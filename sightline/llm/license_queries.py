"""Query of the license scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm.license_scan import html_lines, scan_licenses
from sightline.llm.registry import llm_query
from sightline.llm.tables import table
from sightline.llm.url_filter import host_and_path


@llm_query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every page: its own notice, or the commonest of the nearest directory above it with any on its host.

    A page whose url is its host alone lies in the host's directory; one without a host (null or malformed url)
    lies in none and inherits nothing.
    """
    host, path = host_and_path(F.col("url"))
    place = F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path)))
    pages = table(spark, sf_dir, "pages").select("page_id", place.alias("path"), html_lines(F.col("html")).alias("text"))
    return scan_licenses(pages, "page_id", "path", "text", votes=True).withColumnRenamed("file_id", "page_id")
