"""Failure breakdowns: axes, rig priors, per-dive totals, concentration, residuals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions.geometry import distance
from sightline.functions.labels import (
    HIT_TOLERANCE_PX, INF, PRIOR_DISTANCE_NAMES, error_class, error_or, failure_class,
    no_prediction, pixel_error)
from sightline.operators.frames import positives
from sightline.operators.metrics import MIN_FOR_QUARTILES, with_quartile
from sightline.operators.ordering import (
    attach_scalars, exact_quantiles, join_null_safe, salted_join, value_bucket, value_ranked, with_constants, with_medians)
from sightline.session import cut_lineage

TOP_K = (1, 5, 10, 20, 50)


def failures(per_frame: DataFrame, tolerance: float = HIT_TOLERANCE_PX) -> DataFrame:
    """Positives with ``no_pred``, ``err`` (infinite without prediction) and ``fail``."""
    return (
        positives(per_frame)
        .withColumn("no_pred", no_prediction())
        .withColumn("err", error_or(pixel_error(), "inf"))
        .withColumn("fail", F.col("err") > F.lit(float(tolerance)))
    )


# Error buckets are this much wider for the search of a stratum's middle than for ranks.
BUCKETS_MERGED = 16


def _summary() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("fail")).alias("n_fail"),
        F.avg((~F.col("fail")).cast("double")).alias("hit_rate_n3"),
        F.avg("err").alias("mean_err"),
    ]


def summarize_axis(pos: DataFrame, by: Sequence[str]) -> DataFrame:
    """Failures along one axis, with its share of all failures."""
    by = list(by)
    grouped = with_medians(pos.groupBy(*by).agg(*_summary()), pos, by, {"median_err": "err"})
    # Every positive is in one group, so the groups add up to all failures.
    # Their number may be large (dives), so the total is a scalar of its own.
    total = pos.agg(F.greatest(F.count_if(F.col("fail")), F.lit(1)).alias("_fails"))
    return attach_scalars(grouped, total).select(
        *by, "n", "n_fail", "hit_rate_n3", "median_err", "mean_err",
        (F.col("n_fail") / F.col("n")).alias("failure_rate"),
        (F.col("n_fail") / F.col("_fails")).alias("share_of_failures"))


def _strata(axes: Mapping[str, Sequence[str]]) -> Column:
    """Array of (axis, stratum) of a row's label columns."""
    return F.array(*[
        F.struct(
            F.lit(name).alias("axis"),
            F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]).alias("stratum"))
        for name, columns in axes.items()])


def _axis_medians(cells: DataFrame, labels: Sequence[str], axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Exact median error per (axis, stratum) from counted cells (labels, err, n).

    Counts per (labels, error bucket) are few; only they are repeated per axis, to find the buckets that hold
    each stratum's middle ranks.  Only the cells of these buckets are then looked at one by one.
    """
    known = cells.filter(F.col("err").isNotNull() & ~F.isnan("err")).withColumn(
        "_b", F.floor(value_bucket(F.col("err")) / F.lit(BUCKETS_MERGED)))
    per_bucket = known.groupBy(*labels, "_b").agg(F.sum("n").alias("n")).withColumn("_a", F.explode(_strata(axes)))
    strata = per_bucket.groupBy("_a", "_b").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("_a").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_a")
    total = F.col("_total")
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    middle = (
        strata.withColumn("_past", F.sum("n").over(up)).withColumn("_total", F.sum("n").over(whole))
        .withColumn("_before", F.col("_past") - F.col("n"))
        .filter(((low >= F.col("_before")) & (low < F.col("_past"))) | ((high >= F.col("_before")) & (high < F.col("_past"))))
        .select("_a", "_b", "_before", "_total"))
    wanted = per_bucket.drop("n").join(middle, ["_a", "_b"])
    values = join_null_safe(known, wanted, [*labels, "_b"], "inner").groupBy(
        "_a", "_b", "_before", "_total", "err").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("_a", "_b").orderBy("err").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.withColumn("_past", F.col("_before") + F.sum("n").over(inside)).withColumn(
        "_first", F.col("_past") - F.col("n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_past")), F.col("err")))

    return placed.groupBy("_a").agg(at(low).alias("_low"), at(high).alias("_high")).select(
        "_a.axis", "_a.stratum",
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
            F.col("_low") + (F.col("_high") - F.col("_low")) * F.lit(0.5)).alias("median_err"))


def summarize_axes(pos: DataFrame, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """All axes from one cube: (axis, stratum, n, ...).

    Positives are merged into counted cells (all label columns, error, failure) once, which are written to the
    checkpoint folder; the axes are sums over the cells' few label combinations, so no row is copied per axis.
    ``stratum`` joins the axis values with ``/`` and shows null as ``null``.
    """
    labels = sorted({c for columns in axes.values() for c in columns})
    cells = cut_lineage(pos.groupBy(*labels, "err", "fail").agg(F.count(F.lit(1)).alias("n")))
    known = F.when(F.col("err").isNotNull(), F.col("n"))
    base = cells.groupBy(*labels).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("fail"), F.col("n")).otherwise(F.lit(0))).alias("n_fail"),
        F.sum(known).alias("_known"), F.sum(F.col("err") * F.col("n")).alias("_err"))
    keys = ["axis", "stratum"]
    sums = base.withColumn("_a", F.explode(_strata(axes))).groupBy("_a.axis", "_a.stratum").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_fail", "_known", "_err")])
    fails = F.greatest(F.sum("n_fail").over(Window.partitionBy("axis")), F.lit(1))
    return sums.withColumn("_fails", fails).join(_axis_medians(cells, labels, axes), keys, "left").select(
        *keys, "n", "n_fail", (1 - F.col("n_fail") / F.col("n")).alias("hit_rate_n3"), "median_err",
        F.when(F.col("_known") > 0, F.col("_err") / F.col("_known")).alias("mean_err"),
        (F.col("n_fail") / F.col("n")).alias("failure_rate"),
        (F.col("n_fail") / F.col("_fails")).alias("share_of_failures"))


AXES = {
    "wavelength": ["wavelength"],
    "rig_id": ["rig_id"],
    "rig_id_x_wavelength": ["rig_id", "wavelength"],
    "line_q": ["line_q"],
    "wavelength_x_line_q": ["wavelength", "line_q"],
    "prior_distance": ["prior_q"],
    "fail_class": ["fail_class"],
    "wavelength_x_fail_class": ["wavelength", "fail_class"],
    "err_class": ["err_class"],
    "wavelength_x_err_class": ["wavelength", "err_class"],
}


def hits(pos: DataFrame) -> DataFrame:
    return pos.filter(~F.col("fail") & ~F.col("no_pred"))


def rig_priors(pos: DataFrame) -> DataFrame:
    """Median predicted point of the hits per (rig, colour)."""
    keys = ["rig_id", "wavelength"]
    good = hits(pos)
    counts = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_prior"))
    return with_medians(counts, good, keys, {"prior_x": "pred_x", "prior_y": "pred_y"})


def with_prior_distance(pos: DataFrame, priors: DataFrame) -> DataFrame:
    """Label distance from the rig prior; a null rig or colour matches no prior."""
    joined = salted_join(
        pos, priors.select("rig_id", "wavelength", "prior_x", "prior_y"), ["rig_id", "wavelength"], ["image_id"], "left")
    return joined.withColumn("dist_from_prior", distance(
        F.col("label_x"), F.col("label_y"), F.col("prior_x"), F.col("prior_y")))


def enrich(per_frame: DataFrame, tolerance: float = HIT_TOLERANCE_PX) -> DataFrame:
    """Positives with every stratum: line and prior quartiles, failure and error class.

    Quartiles are taken over the positives.  The joined positives are written to
    the checkpoint folder once; quartile edges are read by a job each.
    """
    pos = cut_lineage(failures(per_frame, tolerance))
    pos = with_quartile(pos, pos, "line_confidence", "line_q")
    near = with_prior_distance(pos, rig_priors(pos))
    near = with_quartile(near, near, "dist_from_prior", "prior_q", PRIOR_DISTANCE_NAMES)
    return near.select(
        "*",
        failure_class(F.col("fail"), F.col("no_pred"), F.col("pred_confidence")).alias("fail_class"),
        error_class(F.col("fail"), F.col("err")).alias("err_class"))


def per_dive_metrics(per_frame: DataFrame) -> DataFrame:
    """Per-dive error summary; missing predictions count nowhere.

    ``hit_rate_n3`` and ``n4`` are over predicted positives only.
    """
    pos = positives(per_frame).withColumn("err", pixel_error())
    err = F.col("err")
    summary = pos.groupBy("dive_id").agg(
        F.count(F.lit(1)).alias("n_positive"),
        F.avg(err).alias("mean_err"),
        F.avg((err <= 3.0).cast("double")).alias("hit_rate_n3"),
        F.avg((err <= 4.0).cast("double")).alias("hit_rate_n4"),
        # Constant within a dive.
        F.min("wavelength").alias("wavelength"),
        F.min("line_confidence").alias("line_confidence"),
    )
    return with_medians(summary, pos, ["dive_id"], {"median_err": "err"})


def worst_first(per_dive: DataFrame) -> DataFrame:
    """Sorted by mean error, dives without any error first."""
    return per_dive.orderBy(F.col("mean_err").desc_nulls_first(), "dive_id")


def colour_quartile_crosstab(per_frame: DataFrame) -> DataFrame:
    """Hit rate and mean error per (colour, line quartile).

    Quartiles are over all joined frames; under four known values it is empty.
    """
    binned = with_quartile(
        per_frame, per_frame, "line_confidence", "line_q", minimum=MIN_FOR_QUARTILES
    ).filter(F.col("line_q").isNotNull())
    pos = positives(binned).withColumn("err", pixel_error())
    return pos.groupBy("wavelength", "line_q").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("err") <= 3.0).cast("double")).alias("hit_rate_n3"),
        F.avg("err").alias("mean_err"))


def per_dive_failures(pos: DataFrame) -> DataFrame:
    """Failures per dive with the mean of finite errors."""
    return pos.groupBy("dive_id").agg(
        F.min("wavelength").alias("wavelength"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("fail")).alias("n_fail"),
        F.avg(F.when(F.col("err") < INF, F.col("err"))).alias("mean_err"),
    ).withColumn("failure_rate", F.col("n_fail") / F.col("n"))


def most_failures_first(per_dive: DataFrame) -> DataFrame:
    return per_dive.orderBy(F.col("n_fail").desc(), "dive_id")


def top_failing(per_dive: DataFrame, k: int = 15) -> DataFrame:
    return most_failures_first(per_dive).limit(k)


def concentration(per_dive: DataFrame, ks: Sequence[int] = TOP_K) -> DataFrame:
    """Failures captured by the K worst dives, for each K and for all dives.

    Dives are merged by failure count first: the window runs over distinct
    counts, not over dives.
    """
    levels = per_dive.groupBy("n_fail").agg(F.count(F.lit(1)).alias("dives"))
    down = Window.orderBy(F.col("n_fail").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    lines = (
        levels.withColumn("_to", F.sum("dives").over(down))
        .withColumn("_fails", F.sum(F.col("n_fail") * F.col("dives")).over(down))
        .withColumn("n_dives", F.sum("dives").over(whole))
        .withColumn("total_failures", F.sum(F.col("n_fail") * F.col("dives")).over(whole))
    )
    asked = F.array_distinct(F.array(*[F.lit(k).cast("long") for k in ks], F.col("n_dives")))
    return (
        lines.withColumn("k", F.explode(asked))
        .filter((F.col("k") <= F.col("_to")) & (F.col("k") > F.col("_to") - F.col("dives")))
        .select(
            "k", "n_dives",
            (F.col("_fails") - (F.col("_to") - F.col("k")) * F.col("n_fail")).alias("captured"),
            "total_failures")
        .withColumn("share", F.when(F.col("total_failures") > 0, F.col("captured") / F.col("total_failures")))
    )


def cumulative_failures(per_dive: DataFrame) -> DataFrame:
    """Rank of each dive by failures and the running total: the Pareto curve."""
    # Most dives share a few levels, so each level is ranked by dive id in slices of its own.
    ranked = value_ranked(per_dive, ["n_fail"], "dive_id", [], "_level_rank")
    levels = per_dive.groupBy("n_fail").agg(F.count(F.lit(1)).alias("dives"))
    higher = Window.orderBy(F.col("n_fail").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = levels.select(
        "n_fail",
        F.coalesce(F.sum("dives").over(higher), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(F.col("n_fail") * F.col("dives")).over(higher), F.lit(0)).alias("_fails"))
    place = F.col("_level_rank") + 1
    return salted_join(ranked, offsets, ["n_fail"], ["dive_id"]).select(
        (F.col("_before") + place).alias("dive_rank"), "dive_id", "n_fail",
        (F.col("_fails") + place * F.col("n_fail")).alias("cum_fail"))


def with_residual(df: DataFrame) -> DataFrame:
    return df.withColumn("dx", F.col("pred_x") - F.col("label_x")).withColumn(
        "dy", F.col("pred_y") - F.col("label_y"))


def residual_stats(pos: DataFrame) -> DataFrame:
    """Bias, spread and error quantiles over the hits (population deviations)."""
    good = with_residual(hits(pos))
    summary = good.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"),
        F.stddev_pop("dx").alias("std_dx"), F.stddev_pop("dy").alias("std_dy"))
    quantiles = exact_quantiles(good, [], {
        "median_dx": ("dx", 0.5), "median_dy": ("dy", 0.5),
        **{f"err_p{int(p * 100)}": ("err", p) for p in (0.25, 0.5, 0.75, 0.95)}})
    return attach_scalars(summary, quantiles)


def residual_bias(pos: DataFrame, keys: Sequence[str] = ("wavelength",)) -> DataFrame:
    return with_residual(hits(pos)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"),
        F.stddev_pop("dx").alias("std_dx"), F.stddev_pop("dy").alias("std_dy"))


def failure_rates(pos: DataFrame, keys: Sequence[str] = ("wavelength", "line_q")) -> DataFrame:
    return pos.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("fail").cast("double")).alias("failure_rate"))


def linear_histogram(
    df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Counts per equal bin [lo, hi); the last bin is closed and outside values drop out."""
    v = F.col(value)
    raw = F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    inside = df.filter((v >= low) & (v <= high))
    return inside.groupBy(*keys, F.least(raw, F.lit(bins)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def log_histogram(
    df: DataFrame, value: str, keys: Sequence[str] = (), edges: int = 40, low: float = 0.1,
    high: float | None = None,
) -> DataFrame:
    """Counts between logarithmic edges from ``low`` to max(value, 10).

    ``edges`` edges make ``edges - 1`` bins.  Without ``high`` the upper edge is
    the largest finite value, read by one job.
    """
    v = F.col(value)
    if high is not None:
        rows = df.withColumn("_top", F.lit(max(float(high), 10.0)))
    else:
        top = df.agg(F.greatest(F.max(F.when(v < INF, v)), F.lit(10.0)).alias("_top"))
        rows = with_constants(df, top)
    at = (F.log10(v) - F.log10(F.lit(low))) / (F.log10("_top") - F.log10(F.lit(low)))
    raw = F.floor(at * F.lit(float(edges - 1))) + 1
    inside = rows.filter((v >= low) & (v <= F.col("_top")))
    return inside.groupBy(*keys, F.least(raw, F.lit(edges - 1)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def line_distance_percentiles(
    flagged: DataFrame, keys: Sequence[str] = (), probs: Sequence[float] = (0.5, 0.9, 0.99)
) -> DataFrame:
    """Label-to-line distance quantiles of positives, to size a corridor."""
    return exact_quantiles(positives(flagged), list(keys), {
        f"p{int(round(p * 100))}": ("perp_distance_to_line", p) for p in probs})

