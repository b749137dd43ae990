"""Two-sample and paired statistics from rank sums and moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.operators.ordering import (
    attach_scalars, average_ranks, exact_quantiles, join_null_safe, rank_sums)


# Enough terms for double precision on both sides of the switch.
SERIES_TERMS = 60


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail erfc(|z| / sqrt 2) from built-in functions.

    Near the centre by the series of erf with positive terms, further out by the
    continued fraction of erfc.
    """
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    square = x * x
    bell = F.exp(-square) / F.lit(math.sqrt(math.pi))
    start = F.struct(x.alias("term"), x.alias("sum"))
    up = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    series = F.aggregate(
        up, start,
        lambda acc, k: F.struct(
            (acc["term"] * 2.0 * square / (2 * k + 1)).alias("term"),
            (acc["sum"] + acc["term"] * 2.0 * square / (2 * k + 1)).alias("sum")),
        lambda acc: acc["sum"])
    fraction = F.aggregate(F.sequence(F.lit(SERIES_TERMS), F.lit(1)), x, lambda acc, k: x + k / 2.0 / acc)
    return F.when(x < 3.0, F.greatest(F.lit(0.0), 1.0 - 2.0 * bell * series)).otherwise(bell / fraction)


def rank_biserial(u: Column, n_a: Column, n_b: Column) -> Column:
    """1 - 2U / (n_a n_b), positive when the first group tends lower."""
    return F.lit(1.0) - F.lit(2.0) * u / (n_a.cast("double") * n_b.cast("double"))


def compare_groups(df: DataFrame, value: str, in_a: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney U, Cohen's d and rank-biserial of two groups: one row, or one per ``keys``.

    ``u_stat`` is that of the first group.  ``z`` is the tie-corrected normal
    approximation with continuity correction; Cohen's d pools sample variances
    and is 0 without spread.  Null and NaN values are left out.
    """
    keys = list(keys)
    rows = df.select(
        *keys, F.col(value).cast("double").alias("v"), in_a.alias("a")
    ).filter(F.col("v").isNotNull() & ~F.isnan("v") & F.col("a").isNotNull())
    a = F.col("a")
    moments = rows.groupBy(*keys).agg(
        F.avg(F.when(a, F.col("v"))).alias("mean_a"), F.avg(F.when(~a, F.col("v"))).alias("mean_b"),
        F.var_samp(F.when(a, F.col("v"))).alias("_va"), F.var_samp(F.when(~a, F.col("v"))).alias("_vb"))
    medians = exact_quantiles(
        rows.select(*keys, F.when(a, F.col("v")).alias("va"), F.when(~a, F.col("v")).alias("vb")), keys,
        {"median_a": ("va", 0.5), "median_b": ("vb", 0.5)})
    ranks = rank_sums(rows, keys, "v", a)
    if keys:
        one = join_null_safe(join_null_safe(ranks, moments, keys), medians, keys)
    else:
        one = attach_scalars(attach_scalars(ranks, moments), medians)
    na, nb = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    n = na + nb
    u = F.col("rank_sum") - na * (na + 1) / 2
    spread = F.sqrt(na * nb / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    distance = F.abs(u - na * nb / 2) - F.lit(0.5)
    pooled = F.sqrt(((na - 1) * F.col("_va") + (nb - 1) * F.col("_vb")) / (na + nb - 2))
    return one.select(
        *keys, F.col("n_first").alias("n_a"), F.col("n_second").alias("n_b"),
        "mean_a", "mean_b", "median_a", "median_b",
        u.alias("u_stat"),
        F.when(spread > 0, F.greatest(distance, F.lit(0.0)) / spread).alias("z"),
        F.when(pooled == 0, F.lit(0.0)).otherwise((F.col("mean_a") - F.col("mean_b")) / pooled)
        .alias("cohens_d"),
        rank_biserial(u, F.col("n_first"), F.col("n_second")).alias("rank_biserial"))


def with_p_value(tests: DataFrame, z: str = "z") -> DataFrame:
    return tests.withColumn("p_value", two_sided_p(F.col(z)))


def paired_deltas(df: DataFrame, after: str, before: str) -> DataFrame:
    """Paired difference without null and NaN rows."""
    return df.withColumn("delta", F.col(after) - F.col(before)).filter(
        F.col("delta").isNotNull() & ~F.isnan("delta"))


def paired_summary(deltas: DataFrame) -> DataFrame:
    """Count, mean, median and share above zero of ``delta``."""
    summary = deltas.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("delta").alias("mean_delta"),
        F.avg((F.col("delta") > 0).cast("double")).alias("fraction_positive"))
    return attach_scalars(summary, exact_quantiles(deltas, [], {"median_delta": ("delta", 0.5)}))


def signed_rank(deltas: DataFrame) -> DataFrame:
    """Wilcoxon signed-rank test on ``delta``, zeros dropped, one row.

    Normal approximation with tie correction and without continuity correction.
    """
    signed = deltas.filter(F.col("delta") != 0).withColumn("_m", F.abs("delta"))
    sums = rank_sums(signed, [], "_m", F.col("delta") > 0)
    n = (F.col("n_first") + F.col("n_second")).cast("double")
    plus = F.col("rank_sum")
    minus = n * (n + 1) / 2 - plus
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24)
    lowest = F.least(plus, minus)
    return sums.select(
        (F.col("n_first") + F.col("n_second")).alias("n"),
        lowest.alias("w_stat"),
        F.when(spread > 0, (lowest - n * (n + 1) / 4) / spread).alias("z"))


__all__ = [
    "average_ranks", "compare_groups", "paired_deltas", "paired_summary", "rank_biserial",
    "signed_rank", "two_sided_p", "with_p_value",
]
