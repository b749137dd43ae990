"""Lines, tags, splits, samples on small fixtures with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import frames as fr
from sightline.operators import lines as ln
from sightline.operators import sampling as sm
from sightline.operators import splits as sp
from sightline.operators import tags as tg
from sightline.operators import tiles as tl
from sightline.operators.ordering import exact_quantiles, first_n, token_ranked

FRAME = "dive_id bigint, image_id bigint, label_x double, label_y double, is_positive boolean, label_string string"


def dives(spark, angles, n=40, spread=500.0, extra=()):
    rng = np.random.default_rng(1)
    rows, image = [], 0
    for dive, angle in enumerate(angles):
        s = rng.uniform(-spread, spread, n)
        e = rng.normal(0, 1, n)
        for a, b in zip(s, e):
            x = 2000 + a * math.cos(angle) - b * math.sin(angle)
            y = 1500 + a * math.sin(angle) + b * math.cos(angle)
            rows.append((dive, image, float(x), float(y), True, "red"))
            image += 1
    for dive, x, y in extra:
        rows.append((dive, image, x, y, True, "red"))
        image += 1
    return spark.createDataFrame(rows, FRAME)


def test_line_recovery_and_confidence(spark):
    angles = [0.1, 0.9, 1.7, 2.8]
    fits = ln.fit_lines(dives(spark, angles)).collect()
    assert len(fits) == 4
    for f in fits:
        want = (-math.sin(angles[f["dive_id"]]), math.cos(angles[f["dive_id"]]))
        assert abs(want[0] * f["line_a"] + want[1] * f["line_b"]) == pytest.approx(1.0, abs=1e-4)
        assert f["is_line_confident"] and f["line_b"] >= 0
        assert f["inlier_count"] >= 38


def test_clustered_dive_is_not_confident(spark):
    fit = ln.fit_lines(dives(spark, [0.5], spread=1.0)).first()
    assert not fit["is_line_confident"]


def test_small_and_degenerate_dives(spark):
    few = spark.createDataFrame([(1, i, float(i), 1.0, True, None) for i in range(4)], FRAME)
    same = spark.createDataFrame([(2, 10 + i, 5.0, 7.0, True, None) for i in range(6)], FRAME)
    got = {r["dive_id"]: r for r in ln.fit_lines(few.unionByName(same)).collect()}
    assert got[1]["line_a"] is None and got[1]["n_positives"] == 4 and not got[1]["is_line_confident"]
    assert got[2]["inlier_count"] == 6 and math.isinf(got[2]["line_confidence"])


def test_mad_floor_flags_only_the_far_point(spark):
    rows = [(1, i, 1000.0 + x, 1000.0, True, None) for i, x in enumerate(np.linspace(-300, 300, 6))]
    rows += [(1, 10, 1100.0, 1000.5, True, None), (1, 11, 1200.0, 1010.0, True, None)]
    f = spark.createDataFrame([(a, b, float(c), d, e, s) for a, b, c, d, e, s in rows], FRAME)
    flagged = {r["image_id"] for r in ln.flag_outliers(f, ln.fit_lines(f)).filter("label_is_outlier").collect()}
    assert flagged == {11}


def test_poisoned_rows_are_flagged(spark):
    f = dives(spark, [0.3, 1.2], extra=[(0, 100.0, 100.0), (1, 100.0, 100.0)])
    out = ln.flag_outliers(f, ln.fit_lines(f)).filter("label_x = 100 and label_y = 100").collect()
    assert [r["label_is_outlier"] for r in out] == [True, True]


def test_lines_do_not_depend_on_partitioning_or_salts(spark):
    f = dives(spark, [0.4, 2.0])
    a = ln.fit_lines(f.repartition(1)).orderBy("dive_id").collect()
    b = ln.fit_lines(f.repartition(7, "image_id"), salts=3).orderBy("dive_id").collect()
    for x, y in zip(a, b):
        assert x["line_c"] == pytest.approx(y["line_c"], abs=1e-6) and x["inlier_count"] == y["inlier_count"]


def test_hot_dive_pool_is_only_for_hypotheses(spark):
    f = dives(spark, [0.7], n=3000)
    fit = ln.fit_lines(f).first()
    assert fit["n_positives"] == 3000 and fit["inlier_count"] > 2900


def test_text_majority(spark):
    groups = {1: ["Red Laser"] * 146 + ["green"] * 2, 2: ["Green"] * 8 + ["RED dot"] * 210,
              3: ["red", "green"], 4: [None, "dot"], 5: ["blue"] * 3 + ["red"], 6: ["reddish", "evergreen"]}
    rows = [(d, i, 0.0, 0.0, True, s) for d, texts in groups.items() for i, s in enumerate(texts)]
    got = {r["dive_id"]: r["wavelength"] for r in tg.text_majority(spark.createDataFrame(rows, FRAME)).collect()}
    assert got == {1: "red", 2: "red", 3: None, 4: None, 5: "blue", 6: None}


def test_cluster_tags(spark):
    rows = [(i, 20.0 + i, 40.0, 200.0 + i) for i in range(5)] + [(10 + i, 20.0, 200.0 + i, 40.0) for i in range(5)]
    colours = spark.createDataFrame(rows, "dive_id bigint, dive_color_b double, dive_color_g double, dive_color_r double")
    got = {r["dive_id"]: r["cluster"] for r in tg.cluster_tags(colours).collect()}
    assert all(got[i] == "red" for i in range(5)) and all(got[10 + i] == "green" for i in range(5))
    assert tg.cluster_tags(colours.limit(1)) is None


def test_splits_sizes_and_strata(spark):
    rows = [(i, "green" if i < 10 else "blue") for i in range(20)]
    w = spark.createDataFrame(rows, "dive_id bigint, wavelength string")
    got = sp.make_splits(w).join(w, "dive_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("wavelength").alias("k")).collect()
    assert {r["split"]: (r["n"], r["k"]) for r in got} == {"train": (16, 2), "val": (2, 2), "test": (2, 2)}
    assert sp.make_splits(w, seed=3).exceptAll(sp.make_splits(w, seed=3)).count() == 0
    with pytest.raises(ValueError):
        sp.make_splits(w, 0.9, 0.2)


def records(spark, n_pos, n_neg, colour="red"):
    rows = [(i, 1.0, colour) for i in range(n_pos)] + [(1000 + i, None, colour) for i in range(n_neg)]
    return spark.createDataFrame(rows, "image_id bigint, label_x double, wavelength string")


@pytest.mark.parametrize("n_pos,n_neg", [(10, 40), (5, 10)])
def test_epoch_is_balanced(spark, n_pos, n_neg):
    epoch = sm.balanced_epoch(records(spark, n_pos, n_neg), seed=1).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in epoch} == {"positive": n_pos, "negative": n_pos}


def test_epoch_without_one_class(spark):
    only = sm.balanced_epoch(records(spark, 5, 0)).collect()
    assert sorted(r["image_id"] for r in only) == list(range(5))
    with pytest.raises(ValueError):
        sm.balanced_epoch(records(spark, 0, 5))


def test_epoch_follows_hardness_and_seed(spark):
    r = records(spark, 200, 10)
    hard = spark.createDataFrame([(1000, 1000.0)] + [(1000 + i, 0.0) for i in range(1, 10)], "image_id bigint, hardness double")
    draws = sm.balanced_epoch(r, hard, seed=2).filter("kind = 'negative'")
    assert draws.count() == 200
    assert draws.filter("image_id = 1000").count() > 190
    again = sm.balanced_epoch(r.repartition(5), hard, seed=2).filter("kind = 'negative'")
    assert draws.exceptAll(again).count() == 0
    other = sm.balanced_epoch(r, None, seed=2, epoch=1)
    assert other.exceptAll(sm.balanced_epoch(r, None, seed=2, epoch=0)).count() > 0


def test_colour_balance(spark):
    r = records(spark, 180, 5).unionByName(records(spark, 20, 0, "green").withColumn("image_id", F.col("image_id") + 5000))
    drawn = sm.balanced_epoch(r, balance_colours=True, seed=3).filter("kind = 'positive'")
    green = drawn.filter("image_id >= 5000").count()
    assert drawn.count() == 200 and 70 <= green <= 130


def test_shards_are_equal_and_disjoint(spark):
    draws = sm.balanced_epoch(records(spark, 21, 40), seed=4)
    sizes = [r["count"] for r in sm.shard(draws, 4).groupBy("shard").count().collect()]
    assert sizes == [10] * 4


def test_hardness_floor(spark):
    neg = spark.createDataFrame([(1, 1.0), (2, 0.5)], "image_id bigint, hardness double")
    new = spark.createDataFrame([(1, 0.0), (9, 3.0)], "image_id bigint, score double")
    assert {r[0]: r[1] for r in sm.upsert_hardness(neg, new).collect()} == {1: 1e-3, 2: 0.5}


def test_subsample_keeps_rare_class(spark):
    got = sm.proportional_subsample(records(spark, 99, 1), 10).collect()
    assert sum(r["label_x"] is None for r in got) == 1 and len(got) == 10
    assert sm.proportional_subsample(records(spark, 5, 5), 100).count() == 10
    assert sm.proportional_subsample(records(spark, 5, 5), 0).count() == 10


def test_tile_grid(spark):
    images = spark.createDataFrame([(1, 2160, 3840), (2, 600, 800), (3, 1024, 1025)], "image_id int, height int, width int")
    grid = tl.tile_grid(images)
    assert {r["image_id"]: r["count"] for r in grid.groupBy("image_id").count().collect()} == {1: 15, 2: 1, 3: 2}
    last = grid.filter("image_id = 1 and tile_idx = 14").first()
    assert (last["tile_x"], last["tile_y"]) == (2816, 1136)
    small = grid.filter("image_id = 2").first()
    assert (small["padded_h"], small["padded_w"]) == (1024, 1024)


def test_crop_holds_label(spark):
    rows = [(i, 1900.0 + i, 1000.0, 2160, 3840) for i in range(200)] + [(900, 5.0, 5.0, 2160, 3840), (901, None, None, 2160, 3840)]
    r = spark.createDataFrame(rows, "image_id bigint, label_x double, label_y double, height int, width int")
    for c in tl.crop_origin(r, centre_p=1.0).collect():
        assert 0 <= c["crop_x"] <= 2816 and 0 <= c["crop_y"] <= 1136
        if c["image_id"] < 200:
            assert 64 <= c["label_x"] - c["crop_x"] <= 960 and 64 <= c["label_y"] - c["crop_y"] <= 960
        if c["image_id"] == 900:
            assert (c["crop_x"], c["crop_y"]) == (0, 0)


def test_gaussian_target(spark):
    p = spark.createDataFrame([(1, 50.0, 30.0), (2, -5.0, 50.0)], "image_id int, local_x double, local_y double")
    cells = tl.gaussian_target(p, 100, 100).collect()
    top = max(cells, key=lambda r: r["target"])
    assert {r["image_id"] for r in cells} == {1} and (top["tx"], top["ty"], top["target"]) == (50, 30, 1.0)
    at3 = next(r["target"] for r in cells if (r["tx"], r["ty"]) == (53, 30))
    assert at3 == pytest.approx(math.exp(-0.5))


def test_superseded_rows(spark):
    f = spark.createDataFrame(
        [(1, 1, 1.0, 1.0, True, False), (1, 2, 1.0, 1.0, False, True), (1, 3, None, None, False, None)],
        "dive_id bigint, image_id bigint, label_x double, label_y double, is_positive boolean, superseded boolean")
    assert [r["image_id"] for r in fr.drop_superseded(f).collect()] == [1]
    assert fr.drop_superseded(f.drop("superseded")).count() == 3


def test_quantiles_with_hot_value_and_infinity(spark):
    v = [5.0] * 500 + [float(i) for i in range(100)] + [float("inf")] * 3
    df = spark.createDataFrame([(None if i % 2 else "a", x) for i, x in enumerate(v)], "k string, v double")
    got = exact_quantiles(df, [], {"q25": ("v", 0.25), "q50": ("v", 0.5), "q99": ("v", 0.99), "q100": ("v", 1.0)}).first()
    finite = np.sort(np.array(v))
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q99", 0.99)):
        assert got[name] == np.quantile(finite[:600], p * 602 / 599)
    assert math.isinf(got["q100"])
    by = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], {"m": ("v", 0.5)}).collect()}
    assert by == {"a": 5.0, None: 5.0}


def test_negative_values_keep_their_order(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1e-4, 300), rng.normal(0, 1e3, 300), [0.0, -0.0]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = exact_quantiles(df, [], {f"q{i}": ("v", i / 20) for i in range(21)}).first()
    for i in range(21):
        assert got[f"q{i}"] == pytest.approx(np.quantile(v, i / 20), abs=1e-12)


def test_first_n_and_ranks_with_one_hot_group(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id")))
    top = first_n(df, ["k"], [F.col("id")], 3, ["id"])
    assert [r["id"] for r in top.filter("k = 0").orderBy("id").collect()] == [0, 1, 2]
    ranks = token_ranked(df, ["k"], F.md5(F.col("id").cast("string")), ["id"], "r", "n").filter("k = 0")
    assert ranks.agg(F.count_distinct("r"), F.max("r"), F.max("n")).first()[:] == (4500, 4499, 4500)


def test_draws_do_not_depend_on_partitions_and_are_linear(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row"), (F.rand(3) * 5).alias("w")).toPandas()
    rows = spark.createDataFrame(rows)
    draws = spark.range(20_000).select(F.col("id").alias("d"), (F.rand(4)).alias("u")).toPandas()
    draws = spark.createDataFrame(draws)
    got = [
        {r["d"]: r["row"] for r in sm.draw_by_weight(draws.repartition(n), rows.repartition(n), "row", "w", "u", 1, slices).collect()}
        for n, slices in ((3, None), (11, 1), (5, 300))]
    assert len(got[0]) == 20_000 and got[0] == got[1] == got[2]


def test_far_ids_spread_over_buckets(spark):
    from sightline.operators import ordering

    first = 1_700_000_000_000_000
    ids = spark.range(first, first + 20_000).withColumnRenamed("id", "v")
    seen = {}
    original = ordering.ranked

    def spy(df, keys, order, bucket, *rest):
        seen["buckets"] = df.select(bucket.alias("b")).distinct().count()
        return original(df, keys, order, bucket, *rest)

    ordering.ranked = spy
    try:
        ranks = ordering.value_ranked(ids, [], "v", [], "r")
        assert ranks.filter(F.col("r") != F.col("v") - F.lit(first)).isEmpty()
    finally:
        ordering.ranked = original
    assert seen["buckets"] > 5_000


def test_splitters_follow_the_data(spark):
    """One outlying id does not put the others into one bucket; ties, nulls and NaN keep their order."""
    from sightline.operators import ordering

    ids = spark.range(60_000).select((F.col("id") + 1_700_000_000_000_000).alias("v")).unionByName(
        spark.createDataFrame([(0,), (1 << 62,)], "v long"))
    cuts = ordering.splitters(ids, "v", 1_000)
    sizes = [r["count"] for r in ids.groupBy(ordering.splitter_bucket(F.col("v"), cuts).alias("b")).count().collect()]
    assert len(sizes) > 50 and max(sizes) < 2_000
    ranks = ordering.value_ranked(ids, [], "v", [], "r", rows_per_bucket=1_000).orderBy("v").select("r")
    assert [r["r"] for r in ranks.collect()] == list(range(60_002))
    rows = [(float(i % 7), i) for i in range(200)] + [(None, 200), (float("nan"), 201), (float("inf"), 202), (float("-inf"), 203)]
    mixed = spark.createDataFrame(rows, "v double, i long")
    for kept in (mixed, mixed.filter("abs(v) < 10 or v is null"), mixed.filter("not abs(v) < 10")):
        for rows_per_bucket in (20, 1_000):
            got = ordering.value_ranked(kept, [], "v", ["i"], "r", rows_per_bucket=rows_per_bucket).orderBy("r").collect()
            assert [r["i"] for r in got] == [r["i"] for r in kept.coalesce(1).orderBy("v", "i").collect()]
    assert ordering.splitters(ids.limit(0), "v", 10) == []
    assert ordering.value_ranked(ids.limit(0), [], "v").count() == 0


def test_two_means_runs_all_starts_together(spark):
    rows = [(i, 20.0 + i % 3, 30.0, 200.0 + i % 5) for i in range(40)] + [(i, 20.0, 210.0 - i % 4, 30.0) for i in range(40, 90)]
    colours = spark.createDataFrame(rows, "dive_id long, dive_color_b double, dive_color_g double, dive_color_r double")
    got = {r["dive_id"]: r["cluster"] for r in tg.cluster_tags(colours.repartition(5)).collect()}
    assert got == {i: "red" if i < 40 else "green" for i in range(90)}
    same = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(5)], colours.schema)
    assert {r["cluster"] for r in tg.cluster_tags(same).collect()} == {"red"}
    frames = spark.createDataFrame([(1, 1)], "dive_id long, image_id long")
    none = spark.createDataFrame([], "image_id long, pred_x double, pred_y double, pred_confidence double")
    raster = spark.createDataFrame([], "image_id long, height int, width int, n_channels int, data binary")
    cold = tg.cold_start_tags(frames, none, raster, 0.5)
    assert cold.count() == 0 and "cluster" in cold.columns
