"""Seeded samples and balanced epochs.

Every choice is an order by, or a uniform from, the md5 of (seed, id): the same
seed gives the same sample whatever the partitioning, and lost tasks recompute
the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions.hashing import token, uniform
from sightline.operators.frames import keep_members, positives
from sightline.operators.ordering import (
    exact_quantiles, first_n, running_weight, salted_join, token_ranked, with_constants)

# Fixed value: lowest weight of a negative, so that none is lost for good.
HARDNESS_FLOOR = 1e-3
# Unit of a weight: 2**-30.  A sum of 8e9 weights of one still fits a bigint.
WEIGHT_UNITS = 1 << 30
# Rows and draws per slice of the cumulative weight in which they meet.
SLICE_ROWS = 65_536


def two_stage_sample(
    frames: DataFrame, max_dives: int = 30, per_dive: int = 5, seed: int = 0
) -> DataFrame:
    """At most ``max_dives`` dives, then at most ``per_dive`` positives of each."""
    pos = positives(frames)
    dives = pos.select("dive_id").distinct().orderBy(token(seed, "dive_id"), "dive_id").limit(max_dives)
    chosen = keep_members(pos, dives, "dive_id")
    order = [token(seed, "image_id"), F.col("image_id"), F.col("label_x"), F.col("label_y")]
    return first_n(chosen, ["dive_id"], order, per_dive, ["image_id"])


def capped_sample(
    df: DataFrame, is_failure: bool, n: int, per_dive: int, seed: int = 0
) -> DataFrame:
    """One outcome only, at most ``per_dive`` rows a dive, then ``n`` overall."""
    pool = df.filter(F.col("is_failure") == F.lit(is_failure))
    tok = token(seed + (1 if is_failure else 2), "image_id")
    capped = first_n(pool, ["dive_id"], [tok, F.col("image_id")], per_dive, ["image_id"])
    return capped.orderBy(tok, "image_id").limit(n)


def proportional_subsample(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` records with the classes in proportion, at least one of each present.

    ``n <= 0`` or ``n`` at or above the record count keeps everything.
    """
    if n <= 0:
        return records
    is_pos = F.col("label_x").isNotNull()
    ranked = token_ranked(
        records.withColumn("_pos", is_pos), ["_pos"], token(seed, "image_id"), ["image_id"], "_r")
    counts = records.agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(is_pos).alias("_npos"))
    sized = with_constants(ranked, counts)
    total, n_pos_all = F.col("_all"), F.col("_npos")
    n_neg_all = total - n_pos_all
    share = F.rint(F.lit(n) * (n_pos_all / F.greatest(total, F.lit(1)))).cast("long")
    want_pos = F.when(
        n_pos_all > 0, F.greatest(F.least(share, n_pos_all), F.lit(1))).otherwise(F.lit(0))
    want_neg = F.greatest(F.least(F.lit(n) - want_pos, n_neg_all), F.lit(0))
    lift = (n_neg_all > 0) & (want_neg == 0)
    limit = F.when(F.col("_pos"), want_pos - lift.cast("int")).otherwise(want_neg + lift.cast("int"))
    return sized.filter((total <= n) | (F.col("_r") < limit)).select(*records.columns)


def upsert_hardness(negatives: DataFrame, updates: DataFrame) -> DataFrame:
    """New scores over old ones, both floored; ids that are no negative are ignored."""
    new = updates.groupBy("image_id").agg(F.max("score").alias("_new"))
    return negatives.join(new, "image_id", "left").withColumn(
        "hardness", F.greatest(F.coalesce("_new", "hardness"), F.lit(HARDNESS_FLOOR))).drop("_new")


def sample_negatives(records: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` negatives without replacement."""
    tok = token(seed, "image_id")
    return records.filter(F.col("label_x").isNull()).orderBy(tok, "image_id").limit(k)


def fixed_weight(weight: Column) -> Column:
    """Weight as an integer number of 2**-30; sums do not depend on their order."""
    return F.rint(weight * F.lit(float(WEIGHT_UNITS))).cast("long")


def draw_by_weight(
    draws: DataFrame,
    rows: DataFrame,
    row_id: str,
    weight: str,
    u: str,
    seed: object = 0,
    slices: int | None = None,
) -> DataFrame:
    """For each draw the row whose cumulative-weight interval holds ``u`` times the total.

    Weights become integers (:func:`fixed_weight`), so cumulative weights are exact and
    independent of the partitioning.  Both sides are cut into equal slices of the
    cumulative weight, by default about as many as there are SLICE_ROWS rows and
    draws.  A row that spans several slices enters each of them, so one row
    with a third of all weight is no hot spot, and every slice begins with a row.
    Inside a slice, rows and draws are merged in one sort and every draw takes
    the last row start before it: no pairs are formed.  The totals are read by
    a job of its own.
    """
    units = rows.select(row_id, fixed_weight(F.col(weight)).alias("_w")).filter(F.col("_w") > 0)
    facts = units.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("weight_total"), F.count(F.lit(1)).alias("_rows"))
    n_draws = draws.agg(F.count(F.lit(1)).alias("_draws"))

    def known(df: DataFrame) -> DataFrame:
        return with_constants(with_constants(df, facts), n_draws)

    placed = known(running_weight(units, "_w", token(seed, row_id), [row_id]))
    # Width of a slice in weight units: integer arithmetic on both sides.
    count = F.lit(slices) if slices else F.floor((F.col("_rows") + F.col("_draws")) / F.lit(SLICE_ROWS)) + 1
    width = F.greatest(F.lit(1), F.ceil(F.col("weight_total") / count)).cast("long")

    spans = (
        placed.withColumn("_width", width)
        .withColumn("_slice", F.explode(F.expr(
            "sequence(weight_before div _width, (weight_before + _w - 1) div _width)")))
        .select(
            "_slice", F.col("weight_before").alias("_at"), F.lit(0).alias("_kind"),
            F.col(row_id).alias("_row"), *[F.lit(None).cast(t).alias(c) for c, t in draws.dtypes])
    )
    wanted = (
        known(draws)
        .filter(F.col("weight_total") > 0)
        .withColumn("_at", F.least(
            F.floor(F.col(u) * F.col("weight_total")), F.col("weight_total") - 1).cast("long"))
        .withColumn("_width", width)
        .select(
            F.expr("_at div _width").alias("_slice"), "_at", F.lit(1).alias("_kind"),
            F.lit(None).cast(dict(rows.dtypes)[row_id]).alias("_row"), *draws.columns)
    )
    upto = Window.partitionBy("_slice").orderBy("_at", "_kind", "_row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        spans.unionByName(wanted)
        .withColumn(row_id, F.last("_row", ignorenulls=True).over(upto))
        .filter(F.col("_kind") == 1)
        .select(*draws.columns, row_id)
    )


def balanced_epoch(
    records: DataFrame,
    hardness: DataFrame | None = None,
    seed: int = 0,
    epoch: int = 0,
    balance_colours: bool = False,
) -> DataFrame:
    """Draws of one training epoch: (draw, kind, image_id), half positive, half negative.

    As many positives as there are, drawn with replacement (inverse colour
    frequency if asked), and as many negatives, weighted by hardness (1 where
    unknown).  Without negatives each positive comes once, or by weight if
    balancing.  No positive at all is an error (checked with a one-row job).
    """
    base = f"{seed}/{epoch}"
    pos = records.filter(F.col("label_x").isNotNull()).select("image_id", "wavelength")
    neg = records.filter(F.col("label_x").isNull()).select("image_id")
    if pos.isEmpty():
        raise ValueError("a balanced epoch needs at least one positive record")
    order = token_ranked(pos, [], token(f"{base}/p", "image_id"), ["image_id"], "r", "n")
    n_neg = neg.agg(F.count(F.lit(1)).alias("n_neg"))
    draws = with_constants(order.select("r", "n"), n_neg)

    if balance_colours:
        # A colour with equal chances first, then a rank inside the colour; a missing tag is a colour of its own.
        ranks = token_ranked(
            pos.withColumn("_colour", F.coalesce(F.concat(F.lit("="), F.col("wavelength")), F.lit(""))),
            ["_colour"], token(f"{base}/pw", "image_id"), ["image_id"], "_i", "_size")
        sizes = ranks.groupBy("_colour").agg(F.max("_size").alias("_size"))
        # One row per colour, so this window is small.
        colours = sizes.withColumn("_c", F.row_number().over(Window.orderBy("_colour")) - 1)
        n_colours = sizes.agg(F.count(F.lit(1)).alias("_n_colours"))
        wanted = with_constants(draws.select("r"), n_colours).withColumn(
            "_u", uniform(f"{base}/pu", "r") * F.col("_n_colours")).withColumn(
            "_c", F.least(F.floor("_u").cast("int"), (F.col("_n_colours") - 1).cast("int")))
        drawn_pos = salted_join(wanted, colours, ["_c"], ["r"]).select(
            "r", "_colour",
            F.least(F.floor((F.col("_u") - F.col("_c")) * F.col("_size")).cast("long"), F.col("_size") - 1).alias("_i"),
        ).join(ranks.select("_colour", "_i", "image_id"), ["_colour", "_i"]).select("r", "image_id")
    else:
        index = F.when(
            F.col("n_neg") > 0,
            F.least(F.floor(uniform(f"{base}/pu", "r") * F.col("n")), F.col("n") - 1),
        ).otherwise(F.col("r")).cast("long")
        drawn_pos = draws.select("r", index.alias("_i")).join(
            order.select(F.col("r").alias("_i"), "image_id"), "_i")

    weighted = neg
    if hardness is not None:
        weighted = upsert_hardness(
            neg.withColumn("hardness", F.lit(1.0)),
            hardness.select("image_id", F.col("hardness").alias("score")))
    else:
        weighted = neg.withColumn("hardness", F.lit(1.0))
    drawn_neg = draw_by_weight(
        draws.select("r", uniform(f"{base}/nu", "r").alias("u")), weighted, "image_id", "hardness", "u", f"{base}/nw")
    return drawn_pos.select(
        F.col("r").alias("draw"), F.lit("positive").alias("kind"), "image_id"
    ).unionByName(drawn_neg.select(
        F.col("r").alias("draw"), F.lit("negative").alias("kind"), "image_id"))


def shard(draws: DataFrame, world: int, seed: object = 0) -> DataFrame:
    """Shuffle, trim to a multiple of ``world`` and deal out: (shard, position)."""
    mixed = token_ranked(draws, [], token(seed, "kind", "draw"), ["kind", "draw"], "_r", "_n")
    usable = F.floor(F.col("_n") / F.lit(world)) * F.lit(world)
    return (
        mixed.filter(F.col("_r") < usable)
        .withColumn("shard", F.pmod("_r", F.lit(world)).cast("int"))
        .withColumn("position", F.floor(F.col("_r") / F.lit(world)).cast("long"))
        .drop("_r", "_n")
    )


def error_bucket(err: Column) -> Column:
    """Hit, low and high borderline or catastrophic; errors between are in no bucket."""
    return (
        F.when(err < 2, F.lit("hit"))
        .when((err >= 3) & (err < 5), F.lit("borderline-low"))
        .when((err >= 5) & (err < 10), F.lit("borderline-high"))
        .when(err > 50, F.lit("catastrophic"))
    )


def bucket_sample(df: DataFrame, per_bucket: int, seed: int = 42) -> DataFrame:
    """At most ``per_bucket`` rows of each error bucket; needs ``err`` and ``image_id``."""
    tagged = df.withColumn("bucket", error_bucket(F.col("err"))).filter(F.col("bucket").isNotNull())
    return first_n(
        tagged, ["bucket"], [token(seed, "image_id"), F.col("image_id")], per_bucket, ["image_id"])


def audit_picks(audit: DataFrame, top: int = 15, colours: Sequence[str] = ("red", "green")) -> DataFrame:
    """Largest blobs, and per colour the rows at 0, n/4, n/2, 3n/4 and n-1 by size.

    The audit table is a bounded sample (dives times rows per dive), so a
    window per colour is bounded too.
    """
    largest = audit.orderBy(F.col("blob_diameter_px").desc(), "image_id").limit(top).withColumn(
        "pick", F.lit("largest"))
    by_size = Window.partitionBy("wavelength").orderBy("blob_diameter_px", "image_id")
    i, n = F.col("_i"), F.col("_n")
    spots = [F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4), n - 1]
    spread = (
        audit.filter(F.col("wavelength").isin(*colours))
        .withColumn("_i", F.row_number().over(by_size) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("wavelength")))
        .filter(i.isin(*spots))
        .drop("_i", "_n")
        .withColumn("pick", F.lit("spread"))
    )
    return largest.unionByName(spread)


def picks_with_frames(picks: DataFrame, frames: DataFrame) -> DataFrame:
    """Audit picks with path, checksum and label of their image; one row per label, null without a frame."""
    facts = ["image_path", "image_checksum", "label_x", "label_y"]
    return picks.join(frames.select("image_id", *facts), "image_id", "left").select(*picks.columns, *facts)


def size_distribution(audit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """min, p10, median, p90, max of the blob diameter."""
    d = "blob_diameter_px"
    return exact_quantiles(audit, list(keys), {
        "d_min": (d, 0.0), "d_p10": (d, 0.1), "d_median": (d, 0.5), "d_p90": (d, 0.9), "d_max": (d, 1.0)})


def best_so_far(history: DataFrame, patience: int) -> DataFrame:
    """Per run and epoch: best score yet, epochs since it rose strictly, stop flag.

    One row per epoch and run, so a run's window is short by nature.
    """
    past = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.max("score").over(past), F.lit(float("-inf")))
    stop = F.col("no_improvement") >= F.lit(patience) if patience > 0 else F.lit(False)
    return (
        history.withColumn("improved", F.col("score") > before)
        .withColumn("best_score", F.max("score").over(upto))
        .withColumn("_at", F.max(F.when(F.col("improved"), F.col("epoch"))).over(upto))
        .withColumn("_pos", F.row_number().over(Window.partitionBy("run_id").orderBy("epoch")))
        .withColumn("_best_pos", F.max(F.when(F.col("improved"), F.col("_pos"))).over(upto))
        .withColumn("no_improvement", (F.col("_pos") - F.coalesce("_best_pos", F.lit(0))).cast("long"))
        .withColumn("best_epoch", F.col("_at"))
        .withColumn("stop", stop)
        .drop("_at", "_pos", "_best_pos")
    )


