"""Group-level splits, stratified by colour tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions.hashing import token
from sightline.operators.ordering import token_ranked


def make_splits(
    wavelengths: DataFrame, train_frac: float = 0.8, val_frac: float = 0.1, seed: int = 0
) -> DataFrame:
    """SPLITS table; a null colour is a stratum of its own.

    Sizes are rounded half to even per stratum and the rest is test.
    """
    for name, share in (("train_frac", train_frac), ("val_frac", val_frac), ("the rest for test", 1 - train_frac - val_frac)):
        if share <= 0:
            raise ValueError(f"{name} must be positive, not {share}")
    ordered = token_ranked(
        wavelengths.select("dive_id", "wavelength"), ["wavelength"], token(seed, "dive_id"),
        ["dive_id"], "r", "n")
    n_train = F.rint(F.col("n") * F.lit(train_frac)).cast("long")
    n_val = F.least(F.rint(F.col("n") * F.lit(val_frac)).cast("long"), F.col("n") - n_train)
    split = (
        F.when(F.col("r") < n_train, F.lit("train"))
        .when(F.col("r") < n_train + n_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return ordered.select("dive_id", split.alias("split"))


def rigs_per_split(frames: DataFrame, splits: DataFrame) -> DataFrame:
    """Dives per (split, rig); the rig is constant within a dive."""
    rigs = frames.groupBy("dive_id").agg(F.min("rig_id").alias("rig_id"))
    return rigs.join(splits, "dive_id").groupBy("split", "rig_id").agg(
        F.count(F.lit(1)).alias("n_dives"))
