"""Robust line per dive and label outlier flags, as joins and aggregates.

The consensus search draws its two-point hypotheses from the seeded shuffle of
each dive; all positives of the dive vote.  Points are joined to one row per
dive that carries its hypotheses as an array, repeated for the parts of a large
dive; the joins of facts are salted, so a dive with a third of all labels is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.geometry import perpendicular_distance
from sightline.functions.hashing import token
from sightline.operators.frames import positives
from sightline.operators.ordering import DEFAULT_SALTS, exact_medians, salted_join, token_ranked
from sightline.session import cut_lineage

# Fixed values of the fit.
MIN_POINTS = 5
INLIER_TOL_PX = 4.0
HYPOTHESES = 200
CONFIDENCE_THRESHOLD = 5.0
MAD_TO_SIGMA = 1.4826
FLAT_VARIANCE = 1e-9
OUTLIER_SIGMA = 3.0
MAD_FLOOR_PX = 1.0
# Points of a dive that vote in one task.
VOTERS_PER_PART = 1 << 12


def _moments(x: str = "label_x", y: str = "label_y") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"),
        F.covar_pop(x, y).alias("sxy"),
    ]


def _least_squares(moments: DataFrame) -> DataFrame:
    """Total least squares normal from central moments, with b > 0 or (b = 0, a > 0).

    The direction of largest spread has angle atan2(2 sxy, sxx - syy) / 2.
    """
    angle = F.lit(0.5) * F.atan2(F.lit(2.0) * F.col("sxy"), F.col("sxx") - F.col("syy"))
    raw = moments.withColumn("_t", angle).withColumn("_a", -F.sin("_t")).withColumn("_b", F.cos("_t"))
    flip = (F.col("_b") < 0) | ((F.col("_b") == 0) & (F.col("_a") < 0))
    sign = F.when(flip, F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        raw.withColumn("line_a", F.col("_a") * sign)
        .withColumn("line_b", F.col("_b") * sign)
        .withColumn("line_c", -(F.col("line_a") * F.col("mx") + F.col("line_b") * F.col("my")))
        .drop("_t", "_a", "_b")
    )


def _variance_ratio(along: Column, across: Column) -> Column:
    return F.when(across <= FLAT_VARIANCE, F.lit(float("inf"))).otherwise(along / across)


def least_squares_lines(frames: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """One-pass total-least-squares line over all positives of each dive.

    Variances along and across the line follow from the same moments, so a
    single map-side combined aggregate is enough.
    """
    fit = _least_squares(positives(frames).groupBy("dive_id").agg(*_moments()))
    a, b = F.col("line_a"), F.col("line_b")
    cross = F.lit(2.0) * a * b * F.col("sxy")
    across = a * a * F.col("sxx") + b * b * F.col("syy") + cross
    along = b * b * F.col("sxx") + a * a * F.col("syy") - cross
    enough = F.col("n") >= MIN_POINTS
    confidence = _variance_ratio(along, across)
    return fit.select(
        "dive_id", F.col("n").alias("n_positives"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("line_a", "line_b", "line_c")],
        F.when(enough, confidence).alias("line_confidence"),
        F.coalesce(enough & (confidence >= threshold), F.lit(False)).alias("is_line_confident"),
    )


def _pool(points: DataFrame, seed: int, hypotheses: int) -> tuple[DataFrame, DataFrame]:
    """All points with the size ``_m`` of their dive, and per dive the points that its hypotheses can name.

    Points are ranked in a seeded order without one task per dive.  A dive of up to twice ``hypotheses`` points
    offers all of them, a larger one those at the ranks that are asked for.  Both tables are written (runs two jobs).
    """
    order = ["image_id", "label_x", "label_y"]
    numbered = cut_lineage(token_ranked(
        points.filter(F.col("dive_id").isNotNull()), ["dive_id"], token(seed, "image_id"), order, "_rank", "_m"
    ).filter(F.col("_m") >= MIN_POINTS))
    few = F.col("_m") <= 2 * hypotheses
    asked = (
        numbered.filter(~few & (F.col("_rank") == 0))
        .select("dive_id", "_m", _hypothesis_numbers(hypotheses))
        .select("dive_id", F.explode(F.array(*_ranks(numbered))).alias("_rank")).distinct())
    columns = ["dive_id", "_rank", "_m", "label_x", "label_y"]
    offered = numbered.filter(few).select(*columns).unionByName(
        numbered.filter(~few).join(asked, ["dive_id", "_rank"]).select(*columns))
    held = F.struct(F.col("_rank").alias("rank"), F.col("label_x").alias("x"), F.col("label_y").alias("y"))
    pool = offered.groupBy("dive_id", "_m").agg(F.array_sort(F.collect_list(held)).alias("_held"))
    return numbered, cut_lineage(pool)


def _hypothesis_numbers(hypotheses: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hypotheses - 1).cast("long"))).alias("h")


def _ranks(points: DataFrame) -> tuple[Column, Column]:
    """Ranks of the two points of hypothesis ``h``: (7919 h + 104729 dive) mod m and a second, always different one."""
    dive = F.col("dive_id")
    if dict(points.dtypes)["dive_id"] != "bigint":
        dive = F.pmod(F.xxhash64("dive_id"), F.lit(1 << 20))
    h, m = F.col("h"), F.col("_m")
    first = F.pmod(F.lit(7919) * h + F.lit(104729) * dive, m)
    return first, F.pmod(first + F.lit(1) + F.pmod(F.lit(15485863) * h + dive, m - 1), m)


def _line_of(pool: DataFrame) -> DataFrame:
    """Add ``l``, the line struct(h, a, b, c) of hypothesis ``h``; null where its points coincide or lack a coordinate."""
    def end(rank: Column) -> Column:
        # Where all points are held, a rank is a place.
        place = F.when(F.size("_held") == F.col("_m"), rank).otherwise(F.array_position(F.col("_held.rank"), rank) - 1)
        return F.get("_held", place.cast("int"))

    first, second = _ranks(pool)
    ends = pool.withColumn("_p", end(first)).withColumn("_q", end(second)).select(
        *[c for c in pool.columns if c != "_held"],
        F.col("_p.x").alias("x0"), F.col("_p.y").alias("y0"),
        (F.col("_q.x") - F.col("_p.x")).alias("dx"), (F.col("_q.y") - F.col("_p.y")).alias("dy"))
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    usable = (F.col("dx") != 0) | (F.col("dy") != 0)
    line = F.when(usable, F.struct(
        F.col("h").cast("int").alias("h"), (-F.col("dy") / norm).alias("a"), (F.col("dx") / norm).alias("b"),
        (-(-F.col("dy") / norm * F.col("x0") + F.col("dx") / norm * F.col("y0"))).alias("c")))
    return ends.withColumn("l", line).drop("x0", "y0", "dx", "dy")


def consensus_lines(
    frames: DataFrame,
    seed: int = 0,
    tol_px: float = INLIER_TOL_PX,
    hypotheses: int = HYPOTHESES,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Best hypothesis per dive: most points strictly within ``tol_px``, then lowest h.

    A dive is cut into one part per ``VOTERS_PER_PART`` points, at most ``salts``: its hypotheses, which outweigh
    the points of a small dive, are repeated and its votes added up only where it is large.
    """
    points = positives(frames).select("dive_id", "image_id", "label_x", "label_y")
    numbered, pool = _pool(points, seed, hypotheses)
    parts = F.least(F.lit(salts), F.ceil(F.col("_m") / VOTERS_PER_PART)).cast("int")
    voters = numbered.select(
        "dive_id", "label_x", "label_y", F.pmod(F.xxhash64("image_id"), parts).cast("int").alias("_part"))
    lines = (
        _line_of(pool.select("*", _hypothesis_numbers(hypotheses)))
        .groupBy("dive_id", "_m").agg(F.collect_list("l").alias("cand"))
        .select("dive_id", "cand", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")))
    # Votes are grouped by two integers; the line itself is made again afterwards.
    votes = (
        voters.join(lines, ["dive_id", "_part"])
        .select("dive_id", "label_x", "label_y", F.explode("cand").alias("l"))
        .filter(perpendicular_distance(
            F.col("label_x"), F.col("label_y"), F.col("l.a"), F.col("l.b"), F.col("l.c")) < tol_px)
        .groupBy("dive_id", F.col("l.h").alias("h")).agg(F.count(F.lit(1)).alias("votes"))
    )
    best = votes.groupBy("dive_id").agg(
        F.max(F.struct("votes", (-F.col("h")).alias("h"))).alias("_best"))
    # A dive whose every pair coincides has no candidate and keeps all points.
    chosen = pool.join(best, "dive_id", "left").withColumn("h", -F.col("_best.h").cast("long"))
    return _line_of(chosen).select(
        "dive_id", F.col("l.h").alias("h"), F.col("l.a").alias("a"), F.col("l.b").alias("b"),
        F.col("l.c").alias("c"), F.col("_best.votes").alias("votes"))


def fit_lines(
    frames: DataFrame,
    seed: int = 0,
    tol_px: float = INLIER_TOL_PX,
    hypotheses: int = HYPOTHESES,
    threshold: float = CONFIDENCE_THRESHOLD,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """LINES table: one row per dive with at least one positive.

    Consensus search, least-squares refit on its inliers, recount, confidence
    from the inliers and robust noise from all positives.  Dives with fewer
    than five positives have null line fields.  The refitted lines are written
    to the checkpoint folder (runs a job).
    """
    points = positives(frames).select("dive_id", "image_id", "label_x", "label_y")
    x, y = F.col("label_x"), F.col("label_y")
    best = consensus_lines(frames, seed, tol_px, hypotheses, salts)
    supported = F.col("votes").isNull() | (F.col("votes") < 2) | (
        perpendicular_distance(x, y, F.col("a"), F.col("b"), F.col("c")) < tol_px)
    # One row per dive: written once, since three later passes start from it.
    refit = cut_lineage(_least_squares(
        salted_join(points, best, ["dive_id"], ["image_id"], salts=salts)
        .filter(supported).groupBy("dive_id").agg(*_moments(), F.max("votes").alias("votes"))
    ).select("dive_id", "line_a", "line_b", "line_c", "votes"))

    a, b, c = F.col("line_a"), F.col("line_b"), F.col("line_c")
    # One row per positive, written once: the statistics, the centre and the spread read it.
    measured = cut_lineage(
        salted_join(points, refit, ["dive_id"], ["image_id"], "left", salts=salts)
        .select(
            "dive_id", "image_id", "line_a", "line_b", "line_c", "votes",
            perpendicular_distance(x, y, a, b, c).alias("d"),
            (a * y - b * x).alias("_u"), (a * x + b * y).alias("_v")))
    # Without a usable hypothesis the line is a plain fit and every point counts.
    inlier = a.isNotNull() & (F.col("votes").isNull() | (F.col("votes") < 2) | (F.col("d") < tol_px))
    stats = measured.groupBy("dive_id", "line_a", "line_b", "line_c").agg(
        F.count(F.lit(1)).alias("n_positives"),
        F.when(a.isNotNull(), F.count_if(inlier)).alias("inlier_count"),
        F.stddev_pop(F.when(inlier, F.col("d"))).alias("residual_std"),
        F.var_pop(F.when(inlier, F.col("_u"))).alias("_along"),
        F.var_pop(F.when(inlier, F.col("_v"))).alias("_across"),
    )
    measured = measured.filter(a.isNotNull())
    centre = exact_medians(measured, ["dive_id"], {"_med": "d"})
    spread = exact_medians(
        salted_join(measured.select("dive_id", "image_id", "d"), centre, ["dive_id"], ["image_id"], salts=salts)
        .withColumn("_dev", F.abs(F.col("d") - F.col("_med"))),
        ["dive_id"], {"_mad": "_dev"})

    confidence = _variance_ratio(F.col("_along"), F.col("_across"))
    return (
        stats.join(spread, "dive_id", "left")
        .select(
            "dive_id", "n_positives", "line_a", "line_b", "line_c", "inlier_count",
            (F.col("inlier_count") / F.col("n_positives")).alias("inlier_fraction"),
            "residual_std",
            (F.lit(MAD_TO_SIGMA) * F.col("_mad")).alias("label_noise_mad"),
            F.when(F.col("line_a").isNotNull(), confidence).alias("line_confidence"),
            F.coalesce(F.col("line_a").isNotNull() & (confidence >= threshold), F.lit(False))
            .alias("is_line_confident"),
        )
    )


def flag_outliers(
    frames: DataFrame,
    lines: DataFrame,
    sigma: float = OUTLIER_SIGMA,
    mad_floor_px: float = MAD_FLOOR_PX,
) -> DataFrame:
    """Frames plus ``label_is_outlier`` and ``perp_distance_to_line``.

    The flag is false, never null, where there is no positive label, no
    confident line or no noise estimate; the distance is filled for every dive
    with a line.
    """
    facts = lines.select(
        "dive_id", *[F.col(c).alias(f"_{c}") for c in (
            "line_a", "line_b", "line_c", "label_noise_mad", "is_line_confident")])
    d = perpendicular_distance(
        F.col("label_x"), F.col("label_y"), F.col("_line_a"), F.col("_line_b"), F.col("_line_c"))
    limit = F.lit(sigma) * F.greatest(F.col("_label_noise_mad"), F.lit(float(mad_floor_px)))
    usable = F.col("is_positive") & F.col("_is_line_confident") & F.col("_label_noise_mad").isNotNull()
    return (
        salted_join(frames, facts, ["dive_id"], ["image_id"], "left")
        .withColumn("perp_distance_to_line", d)
        .withColumn(
            "label_is_outlier",
            F.when(usable, F.col("perp_distance_to_line") > limit).otherwise(F.lit(False)))
        .select(*frames.columns, "label_is_outlier", "perp_distance_to_line")
    )


def pseudo_positives(frames: DataFrame, predictions: DataFrame, min_confidence: float) -> DataFrame:
    """Confident predictions as positive labels (dive_id, image_id, label_x, label_y)."""
    sure = predictions.filter(
        (F.col("pred_confidence") >= min_confidence)
        & F.col("pred_x").isNotNull() & F.col("pred_y").isNotNull())
    return frames.select("dive_id", "image_id").join(sure, "image_id").select(
        "dive_id", "image_id",
        F.col("pred_x").alias("label_x"), F.col("pred_y").alias("label_y"),
        F.lit(True).alias("is_positive"))


def cold_start(
    frames: DataFrame, predictions: DataFrame, min_confidence: float, **fit: object
) -> DataFrame:
    """Line fit from confident predictions, for dives without labels yet.

    Their colours come from :func:`sightline.operators.tags.cold_start_tags`.
    """
    return fit_lines(pseudo_positives(frames, predictions, min_confidence), **fit)
