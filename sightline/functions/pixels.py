"""Pixel-table expressions: HSV, masks, chromaticity, blob scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Hue runs 0..179; red wraps around, from 160 over 0 to 15.
HUES = 180
RED_HUES = (160, 15)
GREEN_HUES = (35, 95)
DETECT_SAT_MIN = 100
DETECT_VAL_MIN = 200
AUDIT_SAT_ABOVE = 60
AUDIT_VAL_ABOVE = 200
MIN_BLOB_AREA = 3
MAX_BLOB_AREA = 1000
MAX_PATCH_FRACTION = 0.25
LINE_PROXIMITY_SIGMA_PX = 9.0


@dataclass(frozen=True)
class Hsv:
    hue: Column
    sat: Column
    val: Column


def hsv(b: Column, g: Column, r: Column) -> Hsv:
    """8-bit HSV (hue 0..179) in the fixed-point arithmetic of common 8-bit code.

    Scale factors are rounded to 1/4096, so borderline pixels fall on the same
    side of a threshold as in that arithmetic.  Written in doubles, which hold
    all values exactly, and with few repeats of the channels: a filter inlines
    these expressions, and generated methods must stay small.
    """
    b, g, r = (c.cast("double") for c in (b, g, r))
    val = F.greatest(b, g, r)
    diff = val - F.least(b, g, r)
    one = F.lit(1.0)

    def scaled(amount: Column, full: float, base: Column) -> Column:
        # A zero base only meets a zero amount.
        factor = F.rint(F.lit(full) / F.greatest(base, one))
        return F.floor((amount * factor + F.lit(2048.0)) / F.lit(4096.0))

    sector = (
        F.when((r >= g) & (r >= b), g - b)
        .when(g >= b, b - r + F.lit(2.0) * diff)
        .otherwise(r - g + F.lit(4.0) * diff)
    )
    return Hsv(
        F.pmod(scaled(sector, 122880.0, diff), F.lit(HUES)), scaled(diff, 1044480.0, val), val.cast("long"))


def _in_range(hue: Column, hues: tuple[int, int]) -> Column:
    """Hue within a range that may wrap; the hue expression enters only once."""
    low, high = hues
    return F.pmod(hue - F.lit(low), F.lit(HUES)) <= F.lit((high - low) % HUES)


def colour_mask(b: Column, g: Column, r: Column, tag: Column) -> Column:
    """Bright, saturated and of the tag's hue; an unknown tag accepts both hues.

    Brightness comes first: it is cheap and drops most pixels.
    """
    parts = hsv(b, g, r)
    other = F.coalesce(tag, F.lit(""))
    hue_ok = ((other != "green") & _in_range(parts.hue, RED_HUES)) | (
        (other != "red") & _in_range(parts.hue, GREEN_HUES))
    return (parts.val >= DETECT_VAL_MIN) & (parts.sat >= DETECT_SAT_MIN) & hue_ok


def audit_mask(b: Column, g: Column, r: Column) -> Column:
    parts = hsv(b, g, r)
    return (parts.val > AUDIT_VAL_ABOVE) & (parts.sat > AUDIT_SAT_ABOVE)


def chromaticity(b: Column, g: Column, r: Column, scale: float = 255.0, eps: float = 1e-3) -> Column:
    """struct(r, g, b) shares of the total intensity; 65535 is the 16-bit scale."""
    rs, gs, bs = r / F.lit(scale), g / F.lit(scale), b / F.lit(scale)
    total = F.greatest(rs + gs + bs, F.lit(eps))
    return F.struct((rs / total).alias("r"), (gs / total).alias("g"), (bs / total).alias("b"))


def blob_score(mean_val: Column, line_distance: Column, line_confident: Column) -> Column:
    """Brightness times closeness to the line, the latter only if it is confident."""
    spread = F.lit(2.0 * LINE_PROXIMITY_SIGMA_PX**2)
    near = F.when(
        F.coalesce(line_confident, F.lit(False)) & line_distance.isNotNull(),
        F.exp(-(line_distance * line_distance) / spread),
    ).otherwise(F.lit(1.0))
    return mean_val / F.lit(255.0) * near


def area_plausible(area: Column) -> Column:
    return area.between(MIN_BLOB_AREA, MAX_BLOB_AREA)


def equivalent_diameter(area: Column) -> Column:
    return F.lit(2.0) * F.sqrt(area / F.pi())
