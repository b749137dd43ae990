"""Metrics, strata, statistics and calibration on hand-computed sets."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import calibrate as cal
from sightline.operators import metrics as mt
from sightline.operators import sampling as sm
from sightline.operators import stats as st
from sightline.operators import strata as sr

FRAMES = "dive_id bigint, image_id bigint, label_x double, label_y double, is_positive boolean"
PRED = "image_id bigint, pred_x double, pred_y double, pred_confidence double"


def tables(spark, preds):
    f = spark.createDataFrame(
        [(10, i, 100.0 * i, 100.0 * i, True) for i in (1, 2, 3, 4)] + [(10, 5, None, None, False), (20, 6, 50.0, 50.0, True)],
        FRAMES)
    s = spark.createDataFrame([(10, "val"), (20, "train")], "dive_id bigint, split string")
    w = spark.createDataFrame([(10, "red"), (20, "green")], "dive_id bigint, wavelength string")
    lines = spark.createDataFrame([(10, 7.0), (20, None)], "dive_id bigint, line_confidence double")
    return spark.createDataFrame(preds, PRED), f, s, w, lines


def as_dict(df):
    return {(r["slice"], r["metric"]): r["value"] for r in df.collect()}


def test_partial_hits(spark):
    preds = [(1, 100.0, 102.0, 0.9), (2, 200.0, 203.5, 0.9), (3, 300.0, 300.0, 0.9), (4, 500.0, 500.0, 0.9), (5, 1.0, 1.0, 0.9)]
    m = as_dict(mt.evaluate(*tables(spark, preds)))
    assert m["overall", "n_frames"] == 5 and m["overall", "n_positive"] == 4
    assert m["overall", "hit_rate_n3"] == 0.5 and m["overall", "hit_rate_n4"] == 0.75
    assert m["overall", "fpr_at_threshold"] == 1.0 and m["overall", "recall_at_threshold"] == 1.0
    assert m["overall", "presence_auroc"] == 0.5
    assert m["wavelength_red", "n_frames"] == 5 and ("wavelength_green", "n_frames") not in m
    # Five known line confidences, all equal: everything is in the lowest bin.
    assert m["line_q1", "n_frames"] == 5 and ("line_q4", "n_frames") not in m


def test_missing_predictions_are_misses_without_error(spark):
    preds = [(1, 100.0, 100.0, 0.9), (2, None, None, 0.0), (3, None, None, None), (4, 400.0, 401.0, 0.9), (5, None, None, 0.1)]
    m = as_dict(mt.evaluate(*tables(spark, preds)))
    assert m["overall", "hit_rate_n3"] == 0.5 and m["overall", "fraction_localized"] == 0.5
    assert m["overall", "mean_pixel_error"] == 0.5 and m["overall", "median_pixel_error"] == 0.5
    assert m["overall", "recall_at_threshold"] == 0.5


def test_absent_class_omits_metrics(spark):
    p, f, s, w, lines = tables(spark, [(6, 50.0, 50.0, 0.7)])
    m = as_dict(mt.evaluate(p, f, s, w, lines, split="train"))
    assert m["overall", "hit_rate_n3"] == 1.0
    assert ("overall", "presence_auroc") not in m and ("overall", "fpr_at_threshold") not in m


def test_auroc(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True)], "s double, y boolean")
    assert mt.auroc(df, [], "s", F.col("y")).first()[0] == 1.0
    assert mt.auroc(df.filter("y"), [], "s", F.col("y")).first()[0] is None
    tied = spark.createDataFrame([(0.5, False), (0.5, True), (0.7, True), (0.2, True)], "s double, y boolean")
    assert mt.auroc(tied, [], "s", F.col("y")).first()[0] == pytest.approx(0.5)


def stratified(spark):
    rows = [
        (1, 1, 0.0, 0.0, True, 1.0, 0.0, 1.0), (1, 2, 0.0, 0.0, True, 7.0, 0.0, 1.0), (1, 3, 0.0, 0.0, True, None, None, 0.0),
        (2, 4, 0.0, 0.0, True, 0.0, 100.0, 0.4), (2, 5, 0.0, 0.0, True, 0.0, 30.0, 1.0), (2, 6, 0.0, 0.0, False, 5.0, 5.0, 1.0)]
    return spark.createDataFrame(
        rows, "dive_id bigint, image_id bigint, label_x double, label_y double, is_positive boolean, pred_x double, pred_y double, pred_confidence double"
    ).withColumn("rig_id", F.lit(1).cast("long")).withColumn(
        "wavelength", F.when(F.col("dive_id") == 1, F.lit("red"))).withColumn("line_confidence", F.col("dive_id").cast("double"))


def test_failure_classes_and_infinite_mean(spark):
    e = {r["image_id"]: r for r in sr.enrich(stratified(spark)).collect()}
    assert [e[i]["err_class"] for i in range(1, 6)] == ["hit", "borderline_3to10", "no_pred", "catastrophic_gt50", "mid_10to50"]
    assert [e[i]["fail_class"] for i in range(1, 6)] == ["hit", "localization", "presence_nopred", "presence_lowconf", "localization"]
    # A null colour has a prior row but matches no frame.
    assert e[4]["prior_q"] == "none" and e[1]["prior_q"] != "none"
    axis = {r["wavelength"]: r for r in sr.summarize_axis(sr.failures(stratified(spark)), ["wavelength"]).collect()}
    assert math.isinf(axis["red"]["mean_err"]) and axis["red"]["median_err"] == 7.0
    assert axis["red"]["share_of_failures"] == 0.5 and axis[None]["n_fail"] == 2


def test_per_dive_skips_missing(spark):
    d = {r["dive_id"]: r for r in sr.per_dive_metrics(stratified(spark)).collect()}
    assert d[1]["n_positive"] == 3 and d[1]["mean_err"] == 4.0 and d[1]["hit_rate_n3"] == 0.5
    order = [r["dive_id"] for r in sr.worst_first(sr.per_dive_metrics(
        stratified(spark).withColumn("pred_x", F.when(F.col("dive_id") == 2, F.col("pred_x"))))).collect()]
    assert order == [1, 2]


def test_concentration(spark):
    per_dive = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (4, 0)], "dive_id bigint, n_fail bigint")
    got = {r["k"]: r["captured"] for r in sr.concentration(per_dive, (1, 2, 3)).collect()}
    assert got == {1: 5, 2: 8, 3: 11, 4: 11}
    assert [r["cum_fail"] for r in sr.cumulative_failures(per_dive).orderBy("dive_rank").collect()] == [5, 8, 11, 11]


def test_mann_whitney_and_effects(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 3.0, 4.0, 8.0]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b] + [(float("nan"), True)], "v double, a boolean")
    row = st.with_p_value(st.compare_groups(df, "v", F.col("a"))).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert row["u_stat"] == u and row["rank_biserial"] == pytest.approx(1 - 2 * u / 20)
    pooled = math.sqrt((4 * np.var(a, ddof=1) + 3 * np.var(b, ddof=1)) / 7)
    assert row["cohens_d"] == pytest.approx((np.mean(a) - np.mean(b)) / pooled)
    ties = 3**3 - 3
    spread = math.sqrt(20 / 12 * (10 - ties / (9 * 8)))
    z = (abs(u - 10) - 0.5) / spread
    assert row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_signed_rank(spark):
    d = [1.0, -2.0, 3.0, 3.0, -1.0, 0.0, 4.0]
    df = spark.createDataFrame([(x,) for x in d], "delta double")
    row = st.signed_rank(df).first()
    # |d| 1 1 2 3 3 4 have ranks 1.5 1.5 3 4.5 4.5 6; the negatives sum to 4.5.
    assert row["n"] == 6 and row["w_stat"] == 4.5
    assert row["z"] == pytest.approx((4.5 - 10.5) / math.sqrt((6 * 7 * 13 - 12 / 2) / 24))
    assert st.paired_summary(df).first()["fraction_positive"] == pytest.approx(4 / 7)


def test_leave_one_out_median_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(d), i, 0.0, 0.0, True, float(np.round(rng.normal(), 1)), float(np.round(rng.normal(), 1)), 1.0)
            for i, d in enumerate(rng.choice([1, 1, 1, 2, 3], 150))] + [(9, 999, 0.0, 0.0, True, None, None, 0.0)]
    pf = spark.createDataFrame(
        rows, "dive_id bigint, image_id bigint, label_x double, label_y double, is_positive boolean, pred_x double, pred_y double, pred_confidence double")
    got = {r["dive_id"]: r for r in cal.leave_one_out(pf, "median").collect()}
    for dive in (1, 2, 3, 9):
        rest = np.array([(r[5], r[6]) for r in rows if r[0] != dive and r[5] is not None and math.hypot(r[5], r[6]) <= 5])
        assert got[dive]["offset_x"] == pytest.approx(np.median(rest[:, 0]))
        assert got[dive]["offset_y"] == pytest.approx(np.median(rest[:, 1]))


def test_rolling_consensus_chunks_do_not_matter(spark):
    rows = [(1, i, float((i * 7) % 13), float((i * 5) % 11)) for i in range(50)]
    df = spark.createDataFrame(rows, "dive_id bigint, image_id bigint, pred_x double, pred_y double")
    whole = {r["image_id"]: r["med_x"] for r in cal.rolling_consensus(df, 3.0).collect()}
    parts = {r["image_id"]: r["med_x"] for r in cal.rolling_consensus(df, 3.0, chunk=4).collect()}
    x = [r[2] for r in rows]
    assert whole == parts == {i: float(np.median(x[max(0, i - 2): i + 3])) for i in range(50)}


def test_best_so_far(spark):
    h = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.1, 0.3, 0.3, 0.2, 0.4])], "run_id string, epoch long, score double")
    rows = sm.best_so_far(h, 2).orderBy("epoch").collect()
    assert [r["no_improvement"] for r in rows] == [0, 0, 1, 2, 0]
    assert [r["stop"] for r in rows] == [False, False, False, True, False]
