"""Hand-computed geometry, label and pixel expressions."""

from __future__ import annotations

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as geo
from sightline.functions import labels as lb
from sightline.functions import pixels as px
from sightline.operators import peaks as pk


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_positive_flag(spark):
    rows = spark.createDataFrame(
        [(1.0, 2.0, None), (1.0, 2.0, True), (1.0, None, False), (1.0, 2.0, False)], "x double, y double, s boolean")
    got = [r[0] for r in rows.select(lb.is_positive(F.col("x"), F.col("y"), F.col("s"))).collect()]
    assert got == [True, False, False, True]


def test_hit_at_tolerance(spark):
    rows = spark.createDataFrame([(2.0,), (5.0,), (100.0,), (None,)], "err double")
    assert [r[0] for r in rows.select(lb.hit(F.col("err"), 3)).collect()] == [True, False, False, False]
    assert [r[0] for r in rows.select(lb.hit(F.col("err"), 5)).collect()] == [True, True, False, False]


def test_projection(spark):
    flat = one(spark, geo.project_onto_line(*lit(50.0, 200.0, 0.0, 1.0, -100.0)).alias("p"))["p"]
    assert (flat["x"], flat["y"]) == (50.0, 100.0)
    k = 1 / math.sqrt(2)
    diagonal = one(spark, geo.project_onto_line(*lit(0.0, 2.0, k, -k, 0.0)).alias("p"))["p"]
    assert diagonal["x"] == pytest.approx(1.0) and diagonal["y"] == pytest.approx(1.0)
    degenerate = one(spark, geo.project_onto_line(*lit(3.0, 4.0, 0.0, 0.0, 1.0)).alias("p"))["p"]
    assert (degenerate["x"], degenerate["y"]) == (3.0, 4.0)


def test_soft_snap(spark):
    def snap(conf_line, conf, alpha_max=0.3):
        return one(spark, geo.soft_snap(*lit(50.0, 200.0, 0.0, 1.0, -100.0, conf_line, conf), alpha_max=alpha_max).alias("s"))["s"]

    sure = snap(20.0, 0.1)
    assert sure["alpha"] == pytest.approx(0.3) and sure["y"] == pytest.approx(170.0) and sure["x"] == 50.0
    assert snap(2.0, 0.95)["alpha"] < 0.05
    assert snap(20.0, 0.1, 0.25)["alpha"] == pytest.approx(0.25)
    assert snap(20.0, 1.0)["y"] == 200.0


def test_rig_prior(spark):
    p = geo.RigPrior()
    assert one(spark, geo.rig_prior_weight(*lit(0.0, 0.0), p))[0] == 0.0
    assert one(spark, geo.rig_prior_weight(*lit(1977.0, 1343.0), p))[0] == 1.0
    low = p.with_overrides(floor=0.15)
    assert one(spark, geo.rig_prior_weight(*lit(1101.0, 2179.0), low))[0] == pytest.approx(0.15)
    assert one(spark, geo.rig_prior_log(*lit(0.0, 0.0), p))[0] == pytest.approx(math.log(1e-4))
    assert p.with_overrides(sigma_x=10.0).sigma_x == p.sigma_x
    assert p.with_overrides(sigma_x=10.0, sigma_y=20.0).sigma_y == 20.0


def test_corridor(spark):
    assert one(spark, geo.corridor_weight(*lit(0.0, 10.0, 0.0, 2.0, 0.0), 10.0))[0] == 1.0
    assert one(spark, geo.corridor_weight(*lit(0.0, 11.0, 0.0, 2.0, 0.0), 10.0))[0] == 0.0
    assert one(spark, geo.corridor_weight(*lit(0.0, 11.0, 0.0, 0.0, 5.0), 10.0))[0] == 1.0


def test_parabola(spark):
    assert one(spark, geo.parabola_shift(*lit(0.5, 1.0, 0.5)))[0] == 0.0
    assert one(spark, geo.parabola_shift(*lit(0.2, 1.0, 0.6)))[0] == pytest.approx(0.5 * (0.2 - 0.6) / (0.2 - 2.0 + 0.6))
    assert one(spark, geo.parabola_shift(*lit(1.0, 1.0, 1.0)))[0] == 0.0
    assert one(spark, geo.parabola_shift(*lit(0.0, 1.0, 2.5)))[0] == 0.0


@pytest.mark.parametrize("flip,turns", [(0, 0), (3, 2), (5, 1), (6, 3)])
def test_rotation_matches_rot90(spark, flip, turns):
    h, w = 5, 7
    world = np.rot90(np.arange(h * w).reshape(h, w), k=turns)
    pixels = spark.createDataFrame([(x, y) for y in range(h) for x in range(w)], "x bigint, y bigint")
    moved = pixels.withColumn("p", geo.forward_rotation(F.col("x"), F.col("y"), F.lit(flip), h, w)).collect()
    for r in moved:
        assert world[r["p"]["y"], r["p"]["x"]] == r["y"] * w + r["x"]
    back = pixels.withColumn("p", geo.forward_rotation(F.col("x"), F.col("y"), F.lit(flip), h, w)).withColumn(
        "q", geo.inverse_rotation(F.col("p.x").cast("double"), F.col("p.y").cast("double"), F.lit(flip), h, w))
    assert all((r["q"]["x"], r["q"]["y"]) == (r["x"], r["y"]) for r in back.collect())


def test_rectify_recovers_distorted_points(spark):
    fx, fy, cx, cy = 3000.0, 3010.0, 2007.0, 1508.0
    k1, k2, p1, p2, k3 = -0.02, 0.004, 0.0002, -0.0001, 0.0005
    rows = []
    for i, (u, v) in enumerate([(2007.0, 1508.0), (1500.0, 1200.0), (2600.0, 1900.0), (900.0, 700.0)]):
        x, y = (u - cx) / fx, (v - cy) / fy
        r2 = x * x + y * y
        radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2**3
        xd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
        yd = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
        rows.append((i, 1, u, v, xd * fx + cx, yd * fy + cy, 4014, 3016))
    rows.append((99, 2, 0.0, 0.0, 10.0, 20.0, 4014, 3016))
    rows.append((100, 1, 0.0, 0.0, None, None, 4014, 3016))
    points = spark.createDataFrame(
        rows, "image_id int, rig_id int, u double, v double, pred_x double, pred_y double, width int, height int")
    rigs = spark.createDataFrame(
        [(1, fx, fy, cx, cy, [k1, k2, p1, p2, k3])], "rig_id int, fx double, fy double, cx double, cy double, dist array<double>")
    got = {r["image_id"]: r for r in pk.rectify_points(points, rigs).collect()}
    for i in range(4):
        assert got[i]["pred_x"] == pytest.approx(got[i]["u"], abs=1e-3)
        assert got[i]["pred_y"] == pytest.approx(got[i]["v"], abs=1e-3)
    assert (got[99]["pred_x"], got[99]["pred_y"]) == (10.0, 20.0)
    assert got[100]["pred_x"] is None
    assert pk.rectify_points(points, None) is points


def test_hsv_close_to_float_hsv(spark):
    rng = np.random.default_rng(0)
    bgr = [tuple(int(c) for c in row) for row in rng.integers(0, 256, (500, 3))]
    df = spark.createDataFrame(bgr, "b int, g int, r int")
    parts = px.hsv(F.col("b"), F.col("g"), F.col("r"))
    for row in df.select("*", parts.hue.alias("h"), parts.sat.alias("s"), parts.val.alias("v")).collect():
        h, s, v = colorsys.rgb_to_hsv(row["r"] / 255, row["g"] / 255, row["b"] / 255)
        assert row["v"] == max(row["b"], row["g"], row["r"])
        assert abs(row["s"] - s * 255) <= 1
        gap = abs(row["h"] - h * 180)
        assert min(gap, 180 - gap) <= 1


def test_colour_mask_wraps_red(spark):
    red, pink_red, green, dark = (0, 0, 255), (40, 0, 255), (0, 255, 0), (0, 0, 150)
    df = spark.createDataFrame([red, pink_red, green, dark], "b int, g int, r int")
    bgr = (F.col("b"), F.col("g"), F.col("r"))

    def mask(tag):
        return [r[0] for r in df.select(px.colour_mask(*bgr, F.lit(tag).cast("string"))).collect()]

    assert mask("red") == [True, True, False, False]
    assert mask("green") == [False, False, True, False]
    assert mask(None) == [True, True, True, False]


def test_missing_policy_is_explicit():
    with pytest.raises(ValueError):
        lb.error_or(None, "unknown")
