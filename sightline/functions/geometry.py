"""Scalar geometry on points, lines, priors and rotations as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Lines are a*x + b*y + c = 0 with (a, b) of length one unless stated otherwise.
DEGENERATE_NORM = 1e-12


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x0 - x1, y0 - y1
    return F.sqrt(dx * dx + dy * dy)


def signed_line_distance(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    return a * x + b * y + c


def perpendicular_distance(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    return F.abs(signed_line_distance(x, y, a, b, c))


def project_onto_line(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    """Foot of the perpendicular as struct(x, y); a degenerate line moves nothing."""
    norm_sq = a * a + b * b
    step = F.when(norm_sq <= DEGENERATE_NORM, F.lit(0.0)).otherwise(
        signed_line_distance(x, y, a, b, c) / norm_sq
    )
    return F.struct((x - step * a).alias("x"), (y - step * b).alias("y"))


def snap_weight(
    line_confidence: Column, confidence: Column, tau: float = 5.0, alpha_max: float = 0.3
) -> Column:
    """Blend weight: trust the line when it is sure and the prediction is not."""
    line_strength = F.lit(1.0) / (F.lit(1.0) + F.exp(-(line_confidence - F.lit(tau))))
    raw = line_strength * (F.lit(1.0) - confidence)
    return F.greatest(F.lit(0.0), F.least(raw, F.lit(alpha_max)))


def soft_snap(
    x: Column,
    y: Column,
    a: Column,
    b: Column,
    c: Column,
    line_confidence: Column,
    confidence: Column,
    tau: float = 5.0,
    alpha_max: float = 0.3,
) -> Column:
    """struct(x, y, alpha): the point moved toward its projection by alpha."""
    alpha = snap_weight(line_confidence, confidence, tau, alpha_max)
    foot = project_onto_line(x, y, a, b, c)
    keep = F.lit(1.0) - alpha
    return F.struct(
        F.when(alpha > 0, keep * x + alpha * foot["x"]).otherwise(x).alias("x"),
        F.when(alpha > 0, keep * y + alpha * foot["y"]).otherwise(y).alias("y"),
        alpha.alias("alpha"),
    )


@dataclass(frozen=True)
class RigPrior:
    """Where a rig's dot may fall.

    Fixed values: the defaults are the published sensor-space box, centre and
    spread.
    """

    x0: float = 1100.0
    y0: float = 700.0
    x1: float = 2950.0
    y1: float = 2180.0
    center_x: float = 1977.0
    center_y: float = 1343.0
    sigma_x: float = 300.0
    sigma_y: float = 300.0
    floor: float = 0.5

    def with_overrides(
        self,
        floor: float | None = None,
        sigma_x: float | None = None,
        sigma_y: float | None = None,
        y1: float | None = None,
    ) -> "RigPrior":
        """Overrides; the spread changes only if both sigmas are given."""
        both = sigma_x is not None and sigma_y is not None
        return RigPrior(
            self.x0, self.y0, self.x1, self.y1 if y1 is None else y1,
            self.center_x, self.center_y,
            sigma_x if both else self.sigma_x,
            sigma_y if both else self.sigma_y,
            self.floor if floor is None else floor,
        )


def rig_prior_weight(x: Column, y: Column, prior: RigPrior = RigPrior(), **columns: Column) -> Column:
    """0 outside the box, else a Gaussian bounded below by the floor.

    ``columns`` may replace ``floor``, ``sigma_x``, ``sigma_y`` or ``y1`` by a
    column, so that a grid of settings is scored in one pass.
    """
    value = {name: columns.get(name, F.lit(float(getattr(prior, name))))
             for name in ("x0", "y0", "x1", "y1", "center_x", "center_y",
                          "sigma_x", "sigma_y", "floor")}
    inside = (
        (x >= value["x0"]) & (x < value["x1"]) & (y >= value["y0"]) & (y < value["y1"])
    )
    zx = (x - value["center_x"]) / value["sigma_x"]
    zy = (y - value["center_y"]) / value["sigma_y"]
    gauss = F.exp(F.lit(-0.5) * (zx * zx + zy * zy))
    return F.when(inside, F.greatest(gauss, value["floor"])).otherwise(F.lit(0.0))


def rig_prior_log(x: Column, y: Column, prior: RigPrior = RigPrior(), eps: float = 1e-4) -> Column:
    """Log weight, bounded below by ln(eps)."""
    return F.log(F.greatest(rig_prior_weight(x, y, prior), F.lit(eps)))


def corridor_weight(
    x: Column, y: Column, a: Column, b: Column, c: Column, corridor_px: Column | float
) -> Column:
    """1 within the corridor around the line, else 0; no usable line gives 1."""
    limit = corridor_px if isinstance(corridor_px, Column) else F.lit(float(corridor_px))
    norm = F.sqrt(a * a + b * b)
    near = perpendicular_distance(x, y, a, b, c) / norm <= limit
    return F.when(norm.isNull() | (norm <= DEGENERATE_NORM), F.lit(1.0)).when(
        near, F.lit(1.0)).otherwise(F.lit(0.0))


def parabola_shift(before: Column, centre: Column, after: Column) -> Column:
    """Vertex offset of three samples, 0 if flat, missing or outside (-0.5, 0.5)."""
    bend = before - F.lit(2.0) * centre + after
    shift = F.when(F.abs(bend) > DEGENERATE_NORM, F.lit(0.5) * (before - after) / bend)
    return F.when((shift > -0.5) & (shift < 0.5), shift).otherwise(F.lit(0.0))


def inverse_rotation(x: Column, y: Column, flip: Column, height: int, width: int) -> Column:
    """World point to sensor point for flip codes 3, 5 and 6; others unchanged.

    ``height`` and ``width`` are those of the sensor raster.
    """
    last_x, last_y = F.lit(float(width - 1)), F.lit(float(height - 1))
    sensor_x = F.when(flip == 3, last_x - x).when(flip == 5, last_x - y).when(flip == 6, y)
    sensor_y = F.when(flip == 3, last_y - y).when(flip == 5, x).when(flip == 6, last_y - x)
    return F.struct(
        F.coalesce(sensor_x, x).alias("x"), F.coalesce(sensor_y, y).alias("y"))


def forward_rotation(x: Column, y: Column, flip: Column, height: int | Column, width: int | Column) -> Column:
    """Sensor pixel to world pixel; undoes :func:`inverse_rotation`."""
    last_x, last_y = F.lit(width - 1), F.lit(height - 1)
    world_x = F.when(flip == 3, last_x - x).when(flip == 5, y).when(flip == 6, last_y - y)
    world_y = F.when(flip == 3, last_y - y).when(flip == 5, last_x - x).when(flip == 6, x)
    return F.struct(
        F.coalesce(world_x, x).alias("x"), F.coalesce(world_y, y).alias("y"))


def clamp(value: Column, low: float, high: Column | float) -> Column:
    """Clamp, keeping null."""
    upper = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(value, upper)))


def in_bounds(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)
