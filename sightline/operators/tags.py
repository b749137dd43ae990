"""Colour tag per dive: label text majority, else two-means over sampled colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.hashing import token, uniform
from sightline.functions.pixels import hsv
from sightline.operators.frames import positives
from sightline.operators.image_blocks import has_images, patch_pixels
from sightline.operators.lines import pseudo_positives
from sightline.operators.ordering import DEFAULT_SALTS, first_n
from sightline.session import cut_lineage

# Recognised colour words and sampling limits.
COLOUR_WORDS = ("red", "green", "blue")
PATCH_HALF = 5
MAX_LABELS_FOR_COLOUR = 10
CLUSTER_SEEDS = 10
CLUSTER_ROUNDS = 300
CLUSTER_TOLERANCE = 1e-4
COLOUR_COLUMNS = ["dive_color_b", "dive_color_g", "dive_color_r"]


def has_word(text: Column, word: str) -> Column:
    """Whole-word, case-insensitive; null text has no word."""
    return F.coalesce(text.rlike(rf"(?i)\b{word}\b"), F.lit(False))


def text_majority(frames: DataFrame) -> DataFrame:
    """Majority colour word over each dive's positive labels; null if none or tied."""
    counts = positives(frames).groupBy("dive_id").agg(*[
        F.count_if(has_word(F.col("label_string"), word)).alias(f"n_{word}")
        for word in COLOUR_WORDS])
    n = [F.col(f"n_{word}") for word in COLOUR_WORDS]
    top = F.greatest(*n)
    holders = sum(((c == top).cast("int") for c in n[1:]), (n[0] == top).cast("int"))
    winner = F.when((top == 0) | (holders > 1), F.lit(None).cast("string"))
    for word, count in zip(COLOUR_WORDS, n):
        winner = winner.when(count == top, F.lit(word))
    return counts.select("dive_id", *[f"n_{w}" for w in COLOUR_WORDS], winner.alias("wavelength"))


def brightest_in_patch(points: DataFrame, raster: DataFrame, half: int = PATCH_HALF) -> DataFrame:
    """Colour of the brightest pixel around each point, first in reading order on ties.

    ``points`` has (dive_id, image_id, label_x, label_y), ``raster`` images or pixel
    rows.  Of images only the patches become rows.  Centres outside the raster yield
    no row.  Several labels of one image count one by one, also where their centres agree.
    """
    centre = points.select(
        "dive_id", "image_id",
        F.rint("label_x").cast("long").alias("cx"), F.rint("label_y").cast("long").alias("cy"),
    ).groupBy("dive_id", "image_id", "cx", "cy").agg(F.count(F.lit(1)).alias("_labels"))
    if has_images(raster):
        near = centre.join(patch_pixels(centre, raster, half), ["image_id", "cx", "cy"])
    else:
        near = centre.join(raster, "image_id").filter(
            F.col("x").between(F.col("cx") - half, F.col("cx") + half)
            & F.col("y").between(F.col("cy") - half, F.col("cy") + half))
    value = hsv(F.col("b"), F.col("g"), F.col("r")).val
    return (
        near.groupBy("dive_id", "image_id", "cx", "cy", "_labels")
        .agg(
            F.max_by(F.struct("b", "g", "r"), F.struct(
                value.alias("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("_c"),
            F.count_if((F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy"))).alias("_centre"))
        .filter(F.col("_centre") > 0)
        .withColumn("_label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_labels"))))
        .select("dive_id", "image_id", *[F.col(f"_c.{k}").cast("double").alias(k) for k in "bgr"])
    )


def dive_colours(
    frames: DataFrame, raster: DataFrame, per_dive: int = MAX_LABELS_FOR_COLOUR,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Mean brightest-pixel colour over the first positives (by image id) of a dive."""
    chosen = first_n(
        positives(frames).select("dive_id", "image_id", "label_x", "label_y"), ["dive_id"],
        [F.col("image_id"), F.col("label_x"), F.col("label_y")], per_dive, ["image_id"], salts)
    return brightest_in_patch(chosen, raster).groupBy("dive_id").agg(
        *[F.avg(k).alias(f"dive_color_{k}") for k in "bgr"])


def _shifted(colours: DataFrame, starts: Sequence[Sequence[Sequence[float]]]) -> list:
    """Per start and centre: sums and number of the nearest colours, and the cost (one job over the colours)."""
    colour = [F.col(c) for c in COLOUR_COLUMNS]

    def distance(centre: Sequence[float]) -> Column:
        return sum(((c - F.lit(float(x))) * (c - F.lit(float(x))) for c, x in zip(colour, centre)), F.lit(0.0))

    seeded = F.explode(F.array(*[
        F.struct(F.lit(i).alias("start"), distance(first).alias("d0"), distance(second).alias("d1"))
        for i, (first, second) in enumerate(starts)]))
    placed = colours.select(*COLOUR_COLUMNS, seeded.alias("_s")).select(
        *COLOUR_COLUMNS, "_s.start", (F.col("_s.d1") < F.col("_s.d0")).cast("int").alias("centre"),
        F.least("_s.d0", "_s.d1").alias("_cost"))
    return placed.groupBy("start", "centre").agg(
        *[F.sum(c).alias(c) for c in COLOUR_COLUMNS], F.count(F.lit(1)).alias("n"), F.sum("_cost").alias("cost")).collect()


def _starting_centres(colours: DataFrame, seeds: int) -> list[list[list[float]]]:
    """Per seed two colours: one by its token, the other by its token among the far ones (a job each for all seeds)."""
    known = colours.dropna(subset=COLOUR_COLUMNS)
    firsts = known.agg(*[
        F.min_by(F.array(*COLOUR_COLUMNS), F.struct(token(s, "dive_id"), "dive_id")).alias(f"c{s}") for s in range(seeds)]).first()
    # Sampling by squared distance: -log(u) / d2 is least with a probability in proportion to d2.
    seconds = []
    for s in range(seeds):
        d2 = sum(((F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(COLOUR_COLUMNS, firsts[s])), F.lit(0.0))
        wait = F.when(d2 > 0, -F.log(F.lit(1.0) - uniform(seeds + s, "dive_id")) / d2)
        seconds.append(F.min_by(F.array(*COLOUR_COLUMNS), F.struct(wait.isNull(), wait, "dive_id")).alias(f"c{s}"))
    second = known.agg(*seconds).first()
    return [[list(firsts[s]), list(second[s])] for s in range(seeds)]


def cluster_tags(colours: DataFrame, seeds: int = CLUSTER_SEEDS, rounds: int = CLUSTER_ROUNDS) -> DataFrame | None:
    """Two-means over dive colours: the redder centre is red, the other green.

    All seeded starts move together: a round is one aggregate by (start, centre), so the number of jobs does
    not depend on the number of starts, and a start that no longer moves costs nothing more to settle.  The
    start with the least cost wins, the first on ties.  Fewer than two dives cannot be clustered: None.
    """
    known = colours.select("dive_id", *COLOUR_COLUMNS).dropna()
    if len(known.limit(2).collect()) < 2:
        return None
    starts = _starting_centres(known, seeds)
    costs = [float("inf")] * seeds
    for _ in range(rounds):
        moved = [[list(c) for c in start] for start in starts]
        sums = _shifted(known, starts)
        costs = [sum(r["cost"] for r in sums if r["start"] == s) for s in range(seeds)]
        for r in sums:
            moved[r["start"]][r["centre"]] = [r[c] / r["n"] for c in COLOUR_COLUMNS]
        settled = all(
            abs(x - y) <= CLUSTER_TOLERANCE for a, b in zip(starts, moved) for p, q in zip(a, b) for x, y in zip(p, q))
        if settled:
            break
        starts = moved
    first, second = starts[costs.index(min(costs))]
    red, other = (first, second) if first[2] - first[1] >= second[2] - second[1] else (second, first)

    def distance(centre: list[float]) -> Column:
        return sum(((F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(COLOUR_COLUMNS, centre)), F.lit(0.0))

    tag = F.when(distance(red) <= distance(other), F.lit("red")).otherwise(F.lit("green"))
    return known.select("dive_id", tag.alias("cluster"))


def resolve_tags(
    frames: DataFrame,
    colours: DataFrame | None = None,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """WAVELENGTHS table: one row per dive; text first, then cluster, else null."""
    dives = frames.select("dive_id").distinct()
    out = dives.join(
        text_majority(frames).select("dive_id", F.col("wavelength").alias("_text")), "dive_id", "left")
    if clusters is not None:
        out = out.join(clusters, "dive_id", "left")
    else:
        out = out.withColumn("cluster", F.lit(None).cast("string"))
    if colours is not None:
        out = out.join(colours, "dive_id", "left")
    else:
        for k in "bgr":
            out = out.withColumn(f"dive_color_{k}", F.lit(None).cast("double"))
    source = F.when(F.col("_text").isNotNull(), F.lit("label_string")).when(
        F.col("cluster").isNotNull(), F.lit("color_cluster"))
    return out.select(
        "dive_id", F.coalesce("_text", "cluster").alias("wavelength"),
        source.alias("wavelength_source"), "dive_color_b", "dive_color_g", "dive_color_r")


def infer_tags(frames: DataFrame, raster: DataFrame | None = None) -> DataFrame:
    """Full inference; without images or pixels only the label text is used.

    The colours, one row per dive, are written once: the raster is scanned once.
    """
    if raster is None:
        return resolve_tags(frames)
    colours = cut_lineage(dive_colours(frames, raster))
    return resolve_tags(frames, colours, cluster_tags(colours))


def cold_start_tags(
    frames: DataFrame, predictions: DataFrame, raster: DataFrame, min_confidence: float
) -> DataFrame:
    """Clustered colour per dive from confident predictions, for dives without labels yet.

    (dive_id, dive_color_b, dive_color_g, dive_color_r, cluster); below two dives no cluster is known and
    the result has no rows.
    """
    points = pseudo_positives(frames, predictions, min_confidence)
    colours = cut_lineage(dive_colours(points, raster))
    clusters = cluster_tags(colours)
    if clusters is None:
        clusters = colours.select("dive_id", F.lit("").alias("cluster")).limit(0)
    return colours.join(clusters, "dive_id")
