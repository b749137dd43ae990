"""Label curation: frames, lines, flags, tags, splits and size audit as artefacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sightline import schemas
from sightline.operators.frames import build_frames, choose_dives
from sightline.operators.lines import fit_lines, flag_outliers
from sightline.operators.raster import size_audit
from sightline.operators.splits import make_splits
from sightline.operators.tags import infer_tags
from sightline.sources.tables import read_or_compute


@dataclass(frozen=True)
class CurationSettings:
    # Column of the images whose largest value marks the image that counts, where an id comes twice.
    image_order: str = "image_order"
    canonical_only: bool = True
    max_dives: int | None = None
    seed: int = 0
    train_frac: float = 0.8
    val_frac: float = 0.1
    audit_dives: int = 30
    audit_per_dive: int = 5
    force: bool = False

    def __post_init__(self) -> None:
        if not (0 < self.train_frac < 1 and 0 < self.val_frac < 1 and self.train_frac + self.val_frac < 1):
            raise ValueError("split fractions must lie in (0, 1) and sum to less than 1")
        if self.audit_dives < 1 or self.audit_per_dive < 1:
            raise ValueError("audit sample sizes must be positive")


def curate(
    spark: SparkSession,
    dives: DataFrame,
    images: DataFrame,
    labels: DataFrame,
    out: str,
    settings: CurationSettings = CurationSettings(),
    pixels: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Run all steps; each writes a table under ``out`` and later steps read it."""
    def step(name: str, compute, schema) -> DataFrame:
        return read_or_compute(spark, f"{out}/{name}.parquet", compute, schema, settings.force)

    chosen = choose_dives(dives, settings.canonical_only, settings.max_dives)
    frames = step("frames", lambda: build_frames(chosen, images, labels, settings.image_order), schemas.FRAMES)
    lines = step("dive_lines", lambda: fit_lines(frames, settings.seed), schemas.LINES)
    flagged = step("frames_flagged", lambda: flag_outliers(frames, lines), schemas.FRAMES_FLAGGED)
    tags = step("dive_wavelengths", lambda: infer_tags(frames, pixels), schemas.WAVELENGTHS)
    splits = step(
        "dive_splits",
        lambda: make_splits(tags, settings.train_frac, settings.val_frac, settings.seed), schemas.SPLITS)
    tables = {"frames": frames, "lines": lines, "flagged": flagged, "tags": tags, "splits": splits}
    if pixels is not None:
        tables["audit"] = step(
            "laser_size_audit",
            lambda: size_audit(frames, tags, pixels, settings.audit_dives, settings.audit_per_dive, settings.seed),
            schemas.AUDIT)
    return tables
