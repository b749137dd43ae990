"""Frames, lines, tags, splits and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.functions.hashing import token
from sightline.operators import frames as fr
from sightline.operators import lines as ln
from sightline.operators import sampling as sm
from sightline.operators import splits as sp
from sightline.operators import tags as tg
from sightline.operators import tiles as tl
from sightline.operators.metrics import core_metrics
from sightline.operators.ordering import first_n, value_ranked
from sightline.plans.curate import CurationSettings, curate
from sightline.session import ensure_checkpoint_dir
from sightline.sources.tables import failed_keys, flips_by_checksum, parse_records, read_or_compute
from workload import views as v
from workload.registry import query
from workload.views_sql import with_ctes

FRAME_COLUMNS = (
    "dive_id, image_id, rig_id, image_path, image_checksum, label_x, label_y, is_positive, label_string, "
    "label_studio_task_id, label_studio_project_id, superseded, completed")


FRAME_TABLE = """
SELECT dive_id, image_id, rig_id, image_path, image_checksum, label_x, label_y,
  label_x IS NOT NULL AND label_y IS NOT NULL AND NOT coalesce(superseded, false) AS is_positive,
  label_string, label_studio_task_id, label_studio_project_id, superseded, completed
FROM (
  SELECT * FROM frames WHERE image_id % 53 <> 0
  UNION ALL
  SELECT * REPLACE (label_x + 2 AS label_x, label_y - 1 AS label_y, label_studio_task_id + 5000000 AS label_studio_task_id)
  FROM frames WHERE image_id % 53 <> 0 AND image_id % 9 = 0)
WHERE dive_id % 11 <> 3
"""


@query("frame_table", FRAME_TABLE, ("frames",), "label_x label_y")
def frame_table(spark, sf):
    return fr.build_frames(
        fr.choose_dives(v.dives(spark, sf)), v.images(spark, sf), v.labels(spark, sf), "seq")


@query("curated_frames", FRAME_TABLE, ("frames",), "label_x label_y")
def curated_frames(spark, sf):
    """The frame table that the curation job writes."""
    out = f"{ensure_checkpoint_dir(spark)}/curated-{uuid.uuid4().hex}"
    settings = CurationSettings(image_order="seq")
    return curate(spark, v.dives(spark, sf), v.images(spark, sf), v.labels(spark, sf), out, settings)["frames"]


@query("chosen_dives", """
SELECT DISTINCT user_id AS dive_id FROM events WHERE user_id % 11 <> 3 ORDER BY dive_id LIMIT 40
""")
def chosen_dives(spark, sf):
    return fr.choose_dives(v.dives(spark, sf), True, 40).select("dive_id")


@query("all_chosen_dives", "SELECT DISTINCT user_id AS dive_id FROM events WHERE user_id % 11 <> 3")
def all_chosen_dives(spark, sf):
    return fr.choose_dives(v.dives(spark, sf)).select("dive_id")


@query("stored_frames", "SELECT image_id, dive_id, image_path, label_x, label_y, is_positive FROM frames", ("frames",), "label_x label_y")
def stored_frames(spark, sf):
    """Frames written by the sink, read back, and found finished the second time."""
    path = f"{ensure_checkpoint_dir(spark)}/frames-{uuid.uuid4().hex}"
    for _ in range(2):
        stored = read_or_compute(spark, path, lambda: v.frames(spark, sf))
    return stored.select("image_id", "dive_id", "image_path", "label_x", "label_y", "is_positive")


# Records of a source as they arrive: every 211th is cut off, every 503rd has a word for a number, every 709th lacks it.
RAW_SQL = """SELECT user_id AS dive_id, event_id AS image_id, CASE WHEN event_id % 211 = 3 THEN 'unreadable' WHEN event_id % 709 = 9 THEN 'missing:k'
  WHEN event_id % 503 = 7 THEN 'malformed:k' END AS problem, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events"""


def _arrived(spark, sf):
    e = v.table(spark, sf, "events")
    i, props = F.col("event_id"), F.col("props")
    raw = F.when(i % 211 == 3, F.concat(F.lit("{"), props, F.lit(","))).when(
        i % 709 == 9, F.lit('{"other": 1}')).when(i % 503 == 7, F.lit('{"k": "many"}')).otherwise(props)
    rows = e.select(F.col("user_id").alias("dive_id"), i.alias("image_id"), raw.alias("payload"))
    return parse_records(rows, "payload", {"k": "bigint"}, ["k"])


@query("parsed_records", f"SELECT dive_id, image_id, CASE WHEN problem IS NULL THEN k END AS k, problem FROM ({RAW_SQL})")
def parsed_records(spark, sf):
    return _arrived(spark, sf)


@query("failed_keys", f"SELECT dive_id, count(*) AS n_bad, min(problem) AS problem FROM ({RAW_SQL}) WHERE problem IS NOT NULL GROUP BY dive_id")
def failed_keys_query(spark, sf):
    return failed_keys(_arrived(spark, sf), "dive_id")


# A source of this workload fails as a whole if one of its records is malformed.
FAILED_SQL = f"SELECT dive_id FROM ({RAW_SQL}) GROUP BY dive_id HAVING count(*) FILTER (WHERE problem LIKE 'malformed%') > 0"


def _failures(spark, sf):
    return failed_keys(_arrived(spark, sf).filter(F.col("problem").startswith("malformed")), "dive_id")


@query("failed_sources", f"""
SELECT count(*) FILTER (WHERE f.dive_id IS NULL) AS n_ok, count(*) FILTER (WHERE f.dive_id IS NOT NULL) AS n_failed
FROM (SELECT DISTINCT user_id AS dive_id FROM events) d LEFT JOIN ({FAILED_SQL}) f USING (dive_id)
""")
def failed_sources(spark, sf):
    return fr.split_failed(v.dives(spark, sf), _failures(spark, sf), "dive_id")[1]


@query("frames_of_good_sources", f"""
SELECT dive_id, count(*) AS n FROM frames WHERE dive_id NOT IN ({FAILED_SQL}) GROUP BY dive_id
""", ("frames",))
def frames_of_good_sources(spark, sf):
    good = fr.split_failed(v.dives(spark, sf), _failures(spark, sf), "dive_id")[0]
    return fr.keep_members(v.frames(spark, sf), good, "dive_id").groupBy("dive_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("rigs_in_use", "SELECT DISTINCT rig_id FROM frames WHERE rig_id IS NOT NULL", ("frames",))
def rigs_in_use(spark, sf):
    return fr.distinct_rigs(v.frames(spark, sf))


@query("frame_counters", """
SELECT count(*) AS n_frames, count(*) FILTER (WHERE is_positive) AS n_positive,
  count(DISTINCT dive_id) AS n_dives, count(DISTINCT rig_id) AS n_rigs FROM frames
""", ("frames",))
def frame_counters(spark, sf):
    return fr.frame_counters(v.frames(spark, sf))


@query("superseded_counts", "SELECT superseded, count(*) AS n FROM frames GROUP BY superseded", ("frames",))
def superseded_counts(spark, sf):
    return fr.value_counts(v.frames(spark, sf), "superseded")


@query("flip_counts", "SELECT flip, count(*) AS n FROM flips GROUP BY flip", ("flips",))
def flip_counts(spark, sf):
    return fr.value_counts(flips_by_checksum(v.flips(spark, sf)), "flip")


@query("positive_points", "SELECT dive_id, image_id, label_x, label_y FROM frames WHERE is_positive",
       ("frames",), "label_x label_y")
def positive_points(spark, sf):
    return fr.positives(v.frames(spark, sf)).select("dive_id", "image_id", "label_x", "label_y")


@query("current_labels", "SELECT image_id, is_positive FROM frames WHERE NOT superseded", ("frames",))
def current_labels(spark, sf):
    return fr.drop_superseded(v.frames(spark, sf)).select("image_id", "is_positive")


@query("split_members", """
SELECT image_id FROM frames WHERE dive_id IN (SELECT dive_id FROM splits WHERE split = 'test')
""", ("frames", "splits"))
def split_members(spark, sf):
    test = v.splits(spark, sf).filter(F.col("split") == "test")
    return fr.keep_members(v.frames(spark, sf), test, "dive_id").select("image_id")


def _available(spark, sf):
    return v.flips(spark, sf).filter(F.col("flip").isNotNull())


@query("cached_and_dropped", """
SELECT count(*) FILTER (WHERE image_id % 29 <> 0) AS n_kept, count(*) FILTER (WHERE image_id % 29 = 0) AS n_dropped FROM frames
""", ("frames",))
def cached_and_dropped(spark, sf):
    return fr.partition_by_presence(v.frames(spark, sf), _available(spark, sf), "image_checksum")[1]


@query("first_label_per_image", """
SELECT image_id, label_studio_task_id, label_x FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label_studio_task_id) AS p FROM (
    SELECT image_id, label_studio_task_id, label_x FROM frames
    UNION ALL SELECT image_id, label_studio_task_id + 5000000, label_x + 2 FROM frames WHERE image_id % 9 = 0)) WHERE p = 1
""", ("frames",), "label_x")
def first_label_per_image(spark, sf):
    f = v.frames(spark, sf).select("image_id", F.col("label_x").alias("x"), F.lit(0.0).alias("y"), "label_studio_task_id")
    both = f.unionByName(v.second_clicks(f)).select("image_id", "label_studio_task_id", F.col("x").alias("label_x"))
    return fr.first_by(both, ["image_id"], ["label_studio_task_id"])


@query("known_colours", "SELECT DISTINCT wavelength FROM tags WHERE wavelength IS NOT NULL", ("tags",))
def known_colours(spark, sf):
    return v.tags(spark, sf).select("wavelength").dropna().distinct()


@query("dive_context", """
SELECT t.dive_id, wavelength, line_a, line_b, line_c, coalesce(is_line_confident, false) AS is_line_confident
FROM tags t LEFT JOIN lines l ON t.dive_id = l.dive_id
""", ("tags", "lines"), "line_a line_b line_c")
def dive_context(spark, sf):
    return fr.classical_context(v.tags(spark, sf), v.lines(spark, sf))


# Lines -----------------------------------------------------------------------

@query("least_squares_lines",
       "SELECT dive_id, n_positives, line_a, line_b, line_c, line_confidence, is_line_confident FROM lines",
       ("lines",), "line_a line_b line_c line_confidence", 4)
def least_squares_lines(spark, sf):
    return v.lines(spark, sf)


@query("consensus_lines", "SELECT dive_id, CAST(h AS INTEGER) AS h, a, b, c, votes FROM consensus", ("consensus",), "a b c", 4)
def consensus_lines(spark, sf):
    return ln.consensus_lines(v.frames(spark, sf))


LINE_DOUBLES = "line_a line_b line_c inlier_fraction residual_std label_noise_mad line_confidence"


@query("fitted_lines", """
SELECT dive_id, n_positives, line_a, line_b, line_c, inlier_count, inlier_fraction, residual_std, label_noise_mad,
  line_confidence, is_line_confident FROM fitted
""", ("fitted",), LINE_DOUBLES, 4)
def fitted_lines(spark, sf):
    return ln.fit_lines(v.frames(spark, sf))


@query("label_outliers", """
SELECT image_id, label_is_outlier, perp_distance_to_line FROM flagged
""", ("flagged",), "perp_distance_to_line", 5)
def label_outliers(spark, sf):
    f = v.frames(spark, sf)
    return ln.flag_outliers(f, ln.fit_lines(f)).select("image_id", "label_is_outlier", "perp_distance_to_line")


@query("label_line_percentiles", """
SELECT quantile_cont(perp_distance_to_line, 0.5) AS p50, quantile_cont(perp_distance_to_line, 0.9) AS p90,
  quantile_cont(perp_distance_to_line, 0.99) AS p99 FROM flagged WHERE is_positive
""", ("flagged",), "p50 p90 p99")
def label_line_percentiles(spark, sf):
    from sightline.operators.strata import line_distance_percentiles

    f = v.frames(spark, sf)
    return line_distance_percentiles(ln.flag_outliers(f, ln.fit_lines(f)))


# The fit over other points: the same fragments on another source.
_FRAME_POINTS = ("label_x AS x, label_y AS y", "FROM frames WHERE is_positive")
_FITTED = with_ctes(("predictions", "fitted"), """
SELECT dive_id, n_positives, line_a, line_b, line_c, inlier_count, inlier_fraction, residual_std, label_noise_mad,
  line_confidence, is_line_confident FROM fitted
""")


def _fitted_over(x_and_y: str, source: str) -> str:
    return _FITTED.replace(_FRAME_POINTS[0], x_and_y).replace(_FRAME_POINTS[1], source)


@query("cold_start_lines", _fitted_over(
    "pred_x AS x, pred_y AS y",
    "FROM frames JOIN predictions USING (image_id) WHERE pred_confidence >= 0.5 AND pred_x IS NOT NULL"),
    (), LINE_DOUBLES, 4)
def cold_start_lines(spark, sf):
    return ln.cold_start(v.frames(spark, sf), v.predictions(spark, sf), 0.5)


@query("large_group_lines", _fitted_over(
    "label_x AS x, label_y AS y", """FROM (
  SELECT o_orderkey % 5 AS dive_id, o_orderkey AS image_id, CAST(o_custkey AS DOUBLE) AS label_x,
    CAST(o_custkey AS DOUBLE) / 2 + CAST((o_orderkey * 7919) % 401 AS DOUBLE) / 50 - 4 AS label_y FROM orders)"""),
    (), LINE_DOUBLES, 4)
def large_group_lines(spark, sf):
    """Five groups with thousands of points each."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("double")
    points = v.table(spark, sf, "orders").select(
        (key % 5).alias("dive_id"), key.alias("image_id"), customer.alias("label_x"),
        (customer / 2 + ((key * 7919) % 401).cast("double") / 50 - 4).alias("label_y"), F.lit(True).alias("is_positive"))
    return ln.fit_lines(points)


# Tags and splits ---------------------------------------------------------------

@query("text_majority", "SELECT dive_id, n_red, n_green, n_blue, wavelength FROM majority", ("majority",))
def text_majority(spark, sf):
    return tg.text_majority(v.frames(spark, sf))


@query("part_name_colours", r"""
SELECT p_brand AS dive_id, count(*) FILTER (WHERE regexp_matches(p_name, '\bred\b', 'i')) AS n_red,
  count(*) FILTER (WHERE regexp_matches(p_name, '\bgreen\b', 'i')) AS n_green,
  count(*) FILTER (WHERE regexp_matches(p_name, '\bblue\b', 'i')) AS n_blue FROM part GROUP BY p_brand
""")
def part_name_colours(spark, sf):
    parts = v.table(spark, sf, "part").select(
        F.col("p_brand").alias("dive_id"), F.col("p_name").alias("label_string"), F.lit(True).alias("is_positive"))
    return tg.text_majority(parts).select("dive_id", "n_red", "n_green", "n_blue")


@query("resolved_tags", """
SELECT dive_id, wavelength, wavelength_source, CAST(NULL AS DOUBLE) AS dive_color_b,
  CAST(NULL AS DOUBLE) AS dive_color_g, CAST(NULL AS DOUBLE) AS dive_color_r FROM tags
""", ("tags",))
def resolved_tags(spark, sf):
    return v.tags(spark, sf)


@query("dive_splits", "SELECT dive_id, split FROM splits", ("splits",))
def dive_splits(spark, sf):
    return v.splits(spark, sf)


@query("rigs_per_split", """
SELECT split, rig_id, count(*) AS n_dives FROM (SELECT dive_id, min(rig_id) AS rig_id FROM frames GROUP BY dive_id)
JOIN splits USING (dive_id) GROUP BY split, rig_id
""", ("frames", "splits"))
def rigs_per_split(spark, sf):
    return sp.rigs_per_split(v.frames(spark, sf), v.splits(spark, sf))


# Samples -------------------------------------------------------------------------

@query("two_stage_sample", """
SELECT image_id FROM (
  SELECT image_id, row_number() OVER (PARTITION BY dive_id ORDER BY md5('0:' || image_id), image_id) AS p
  FROM frames WHERE is_positive AND dive_id IN (
    SELECT dive_id FROM frames WHERE is_positive GROUP BY dive_id ORDER BY md5('0:' || dive_id), dive_id LIMIT 30)) WHERE p <= 5
""", ("frames",))
def two_stage_sample(spark, sf):
    return sm.two_stage_sample(v.frames(spark, sf)).select("image_id")


@query("capped_failures", """
SELECT image_id FROM (
  SELECT image_id, row_number() OVER (PARTITION BY dive_id ORDER BY md5('8:' || image_id), image_id) AS p FROM pos WHERE fail)
WHERE p <= 3 ORDER BY md5('8:' || image_id), image_id LIMIT 100
""", ("pos",))
def capped_failures(spark, sf):
    pos = v.positives(spark, sf).withColumn("is_failure", F.col("fail"))
    return sm.capped_sample(pos, True, 100, 3, seed=7).select("image_id")


SUBSAMPLE_SQL = """
SELECT image_id FROM (
  SELECT image_id, is_pos, row_number() OVER (PARTITION BY is_pos ORDER BY md5('0:' || image_id), image_id) AS p,
    sum(CAST(is_pos AS INTEGER)) OVER () AS np, count(*) OVER () AS nall
  FROM (SELECT image_id, is_positive AS is_pos FROM frames))
WHERE p <= CASE WHEN is_pos THEN CAST(round_even(200.0 * np / nall, 0) AS BIGINT)
  ELSE 200 - CAST(round_even(200.0 * np / nall, 0) AS BIGINT) END
"""


def _records(spark, sf):
    return fr.build_records(
        v.frames(spark, sf), v.tags(spark, sf), v.lines(spark, sf), drop_superseded_rows=False)


@query("proportional_subsample", SUBSAMPLE_SQL, ("frames",))
def proportional_subsample(spark, sf):
    return sm.proportional_subsample(_records(spark, sf), 200).select("image_id")


@query("subsample_metrics", f"""
SELECT count(*) AS n_frames, count(*) FILTER (WHERE is_positive) AS n_positive,
  avg(CAST(coalesce(raw_err <= 3, false) AS INTEGER)) FILTER (WHERE is_positive) AS hit_rate_n3,
  avg(raw_err) FILTER (WHERE is_positive) AS mean_pixel_error,
  quantile_cont(raw_err, 0.5) FILTER (WHERE is_positive) AS median_pixel_error
FROM per_frame WHERE image_id IN ({SUBSAMPLE_SQL})
""", ("per_frame",), "hit_rate_n3 mean_pixel_error median_pixel_error")
def subsample_metrics(spark, sf):
    chosen = sm.proportional_subsample(_records(spark, sf), 200)
    rows = fr.keep_members(v.joined(spark, sf), chosen, "image_id")
    return core_metrics(rows).select(
        "n_frames", "n_positive", "hit_rate_n3", "mean_pixel_error", "median_pixel_error")


def _hardness(spark, sf):
    return v.table(spark, sf, "events").select(
        F.col("event_id").alias("image_id"), (F.col("event_id") % 7 + 1).cast("double").alias("hardness"))


EPOCH_SQL = """
WITH p AS (
  SELECT image_id, row_number() OVER (ORDER BY md5('0/2/p:' || image_id), image_id) - 1 AS r, count(*) OVER () AS n
  FROM frames WHERE is_positive),
q AS (
  SELECT image_id, w, sum(w) OVER (ORDER BY md5('0/2/nw:' || image_id), image_id) - w AS lo, sum(w) OVER () AS total
  FROM (SELECT image_id, CAST(image_id % 7 + 1 AS DOUBLE) AS w FROM frames WHERE NOT is_positive)),
d AS (
  SELECT r, n, CAST(CAST('0x' || substr(md5('0/2/pu:' || r), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS up,
    CAST(CAST('0x' || substr(md5('0/2/nu:' || r), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS un FROM p)
SELECT d.r AS draw, 'positive' AS kind, p.image_id FROM d JOIN p ON p.r = CAST(floor(d.up * d.n) AS BIGINT)
UNION ALL
SELECT d.r, 'negative', q.image_id FROM d JOIN q ON d.un * q.total >= q.lo AND d.un * q.total < q.lo + q.w
"""


@query("balanced_epoch", f"SELECT * FROM ({EPOCH_SQL})", ("frames",))
def balanced_epoch(spark, sf):
    return sm.balanced_epoch(_records(spark, sf), _hardness(spark, sf), seed=0, epoch=2)


@query("sharded_epoch", f"""
SELECT CAST((r % 4) AS INTEGER) AS shard, r // 4 AS position, kind, image_id FROM (
  SELECT *, row_number() OVER (ORDER BY md5('5:' || kind || ':' || draw), kind, draw) - 1 AS r, count(*) OVER () AS n
  FROM ({EPOCH_SQL})) WHERE r < n // 4 * 4
""", ("frames",))
def sharded_epoch(spark, sf):
    draws = sm.balanced_epoch(_records(spark, sf), _hardness(spark, sf), seed=0, epoch=2)
    return sm.shard(draws, 4, seed=5).select("shard", "position", "kind", "image_id")


_UNIFORM = "CAST(CAST('0x' || substr(md5('1/0/{}:' || r), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496"


@query("colour_balanced_epoch", f"""
SELECT * FROM (
WITH p AS (
  SELECT image_id, coalesce('=' || wavelength, '') AS colour FROM frames LEFT JOIN tags USING (dive_id) WHERE is_positive),
k AS (
  SELECT image_id, colour, row_number() OVER (PARTITION BY colour ORDER BY md5('1/0/pw:' || image_id), image_id) - 1 AS i,
    count(*) OVER (PARTITION BY colour) AS size FROM p),
c AS (SELECT *, row_number() OVER (ORDER BY colour) - 1 AS ci, count(*) OVER () AS nc FROM (SELECT DISTINCT colour, size FROM k)),
q AS (
  SELECT image_id, row_number() OVER (ORDER BY md5('1/0/nw:' || image_id), image_id) - 1 AS i, count(*) OVER () AS n
  FROM frames WHERE NOT is_positive),
d AS (SELECT range AS r FROM range((SELECT count(*) FROM p))),
u AS (SELECT r, nc, {_UNIFORM.format('pu')} * nc AS up, {_UNIFORM.format('nu')} AS un FROM d, (SELECT DISTINCT nc FROM c)),
w AS (SELECT *, least(CAST(floor(up) AS BIGINT), nc - 1) AS ci FROM u)
SELECT w.r AS draw, 'positive' AS kind, k.image_id FROM w JOIN c USING (ci)
JOIN k ON k.colour = c.colour AND k.i = least(CAST(floor((w.up - w.ci) * c.size) AS BIGINT), c.size - 1)
UNION ALL SELECT u.r, 'negative', q.image_id FROM u JOIN q ON q.i = CAST(floor(u.un * q.n) AS BIGINT))
""", ("frames", "tags"))
def colour_balanced_epoch(spark, sf):
    return sm.balanced_epoch(_records(spark, sf), None, seed=1, epoch=0, balance_colours=True)


@query("colour_group_weights", """
SELECT wavelength, count(*) AS n, 1.0 / count(*) AS weight FROM frames LEFT JOIN tags USING (dive_id)
WHERE is_positive GROUP BY wavelength
""", ("frames", "tags"), "weight", 9)
def colour_group_weights(spark, sf):
    pos = _records(spark, sf).filter(F.col("label_x").isNotNull())
    return fr.value_counts(pos, "wavelength").withColumn("weight", F.lit(1.0) / F.col("n"))


@query("hardness_upsert", """
SELECT image_id, greatest(CASE WHEN image_id % 3 = 0 THEN CAST(image_id % 5 AS DOUBLE) / 10 ELSE 1 END, CAST(0.001 AS DOUBLE)) AS hardness
FROM frames WHERE NOT is_positive
""", ("frames",), "hardness")
def hardness_upsert(spark, sf):
    f = v.frames(spark, sf)
    negatives = f.filter(~F.col("is_positive")).select("image_id", F.lit(1.0).alias("hardness"))
    updates = f.filter(F.col("image_id") % 3 == 0).select(
        "image_id", ((F.col("image_id") % 5).cast("double") / 10).alias("score"))
    return sm.upsert_hardness(negatives, updates)


@query("sampled_negatives", """
SELECT image_id FROM frames WHERE NOT is_positive ORDER BY md5('3:' || image_id), image_id LIMIT 50
""", ("frames",))
def sampled_negatives(spark, sf):
    return sm.sample_negatives(_records(spark, sf), 50, seed=3).select("image_id")


RECORD_SQL = """
SELECT f.dive_id, f.image_id, f.rig_id, f.image_path, f.image_checksum,
  CASE WHEN is_positive THEN CASE flip WHEN 3 THEN 4013 - label_x WHEN 5 THEN 4013 - label_y WHEN 6 THEN label_y ELSE label_x END END AS label_x,
  CASE WHEN is_positive THEN CASE flip WHEN 3 THEN 3015 - label_y WHEN 5 THEN label_x WHEN 6 THEN 3015 - label_x ELSE label_y END END AS label_y,
  wavelength, line_a, line_b, line_c,
  CASE WHEN line_a IS NOT NULL THEN coalesce(line_confidence, 0) ELSE 0 END AS line_confidence,
  line_a IS NOT NULL AND coalesce(is_line_confident, false) AS is_line_confident
FROM frames f LEFT JOIN tags USING (dive_id) LEFT JOIN lines USING (dive_id) LEFT JOIN flips USING (image_checksum)
WHERE NOT superseded
"""
RECORD_DOUBLES = "label_x label_y line_a line_b line_c line_confidence"


@query("training_records", RECORD_SQL, ("frames", "tags", "lines", "flips"), RECORD_DOUBLES, 4)
def training_records(spark, sf):
    return fr.build_records(v.frames(spark, sf), v.tags(spark, sf), v.lines(spark, sf), v.flips(spark, sf))


@query("split_records", f"""
SELECT image_id, label_x, label_y, is_line_confident FROM ({RECORD_SQL}) WHERE dive_id IN (
  SELECT dive_id FROM splits WHERE split = 'train' ORDER BY dive_id LIMIT 60)
""", ("frames", "tags", "lines", "flips", "splits"), "label_x label_y", 5)
def split_records(spark, sf):
    return fr.split_records(
        v.frames(spark, sf), v.splits(spark, sf), "train", v.tags(spark, sf), v.lines(spark, sf),
        v.flips(spark, sf), max_dives=60).select("image_id", "label_x", "label_y", "is_line_confident")


@query("all_split_records", f"""
SELECT image_id, label_x, label_y, is_line_confident FROM ({RECORD_SQL}) WHERE dive_id IN (
  SELECT dive_id FROM splits WHERE split = 'train')
""", ("frames", "tags", "lines", "flips", "splits"), "label_x label_y", 5)
def all_split_records(spark, sf):
    return fr.split_records(
        v.frames(spark, sf), v.splits(spark, sf), "train", v.tags(spark, sf), v.lines(spark, sf),
        v.flips(spark, sf)).select("image_id", "label_x", "label_y", "is_line_confident")


@query("error_bucket_sample", """
SELECT bucket, image_id FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || image_id), image_id) AS p FROM (
    SELECT image_id, CASE WHEN raw_err < 2 THEN 'hit' WHEN raw_err >= 3 AND raw_err < 5 THEN 'borderline-low'
      WHEN raw_err >= 5 AND raw_err < 10 THEN 'borderline-high' WHEN raw_err > 50 THEN 'catastrophic' END AS bucket
    FROM per_frame WHERE is_positive AND pred_x IS NOT NULL) WHERE bucket IS NOT NULL) WHERE p <= 3
""", ("per_frame",))
def error_bucket_sample(spark, sf):
    from sightline.operators.calibrate import localized

    return sm.bucket_sample(localized(v.joined(spark, sf)), 3).select("bucket", "image_id")


@query("first_ten_positives", """
SELECT dive_id, image_id FROM (
  SELECT dive_id, image_id, row_number() OVER (PARTITION BY dive_id ORDER BY image_id) AS p FROM frames WHERE is_positive) WHERE p <= 10
""", ("frames",))
def first_ten_positives(spark, sf):
    return first_n(fr.positives(v.frames(spark, sf)).select("dive_id", "image_id"), ["dive_id"],
                   [F.col("image_id")], 10, ["image_id"])


@query("row_index", """
SELECT dive_id, image_id, row_number() OVER (PARTITION BY dive_id ORDER BY image_id) - 1 AS row_index FROM frames
""", ("frames",))
def row_index(spark, sf):
    return value_ranked(v.frames(spark, sf).select("dive_id", "image_id"), ["dive_id"], "image_id", rank="row_index")


@query("global_row_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders
""")
def global_row_index(spark, sf):
    return value_ranked(v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], "o_totalprice",
                        ["o_orderkey"], "row_index").drop("o_totalprice")


@query("best_so_far", """
SELECT run_id, epoch, score, best_score, improved, pos - coalesce(best_pos, 0) AS no_improvement,
  pos - coalesce(best_pos, 0) >= 5 AS stop, best_epoch FROM (
  SELECT *, max(CASE WHEN improved THEN pos END) OVER w AS best_pos, max(CASE WHEN improved THEN epoch END) OVER w AS best_epoch FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS pos,
      max(score) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_score,
      score > coalesce(max(score) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('-inf' AS DOUBLE)) AS improved
    FROM (SELECT o_orderstatus AS run_id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS epoch,
      CAST(floor(avg(o_totalprice)) AS DOUBLE) AS score FROM orders GROUP BY 1, 2))
  WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING))
""", (), "score best_score")
def best_so_far(spark, sf):
    return sm.best_so_far(v.history(spark, sf), 5)


# Tiles and targets ------------------------------------------------------------------

GRID_SQL = """
SELECT image_id, height, width, greatest(height, 1024) AS padded_h, greatest(width, 1024) AS padded_w,
  CAST(row_number() OVER (PARTITION BY image_id ORDER BY tile_y, tile_x) - 1 AS INTEGER) AS tile_idx, tile_x, tile_y
FROM (
  SELECT image_id, height, width, unnest(xs) AS tile_x, tile_y FROM (
    SELECT image_id, height, width, CASE WHEN width <= 1024 THEN [CAST(0 AS BIGINT)] ELSE list_append(range(0, width - 1024, 768), width - 1024) END AS xs,
      unnest(CASE WHEN height <= 1024 THEN [CAST(0 AS BIGINT)] ELSE list_append(range(0, height - 1024, 768), height - 1024) END) AS tile_y
    FROM (SELECT event_id AS image_id, CASE event_id % 3 WHEN 0 THEN 2160 WHEN 1 THEN 600 ELSE 3016 END AS height,
      CASE event_id % 3 WHEN 0 THEN 3840 WHEN 1 THEN 800 ELSE 4014 END AS width FROM events)))
"""


@query("tile_grid", GRID_SQL)
def tile_grid(spark, sf):
    return tl.tile_grid(v.sized_images(spark, sf))


FULL_GRID = """
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tile_y, tile_x) - 1 AS tile_idx FROM (
    SELECT *, unnest([0, 768, 1536, 2304, 2990]) AS tile_x FROM (SELECT *, unnest([0, 768, 1536, 1992]) AS tile_y FROM records))
"""


@query("tiles_holding_labels", f"""
SELECT image_id, CAST(tile_idx AS INTEGER) AS tile_idx FROM ({FULL_GRID})
WHERE label_x >= tile_x AND label_x < tile_x + 1024 AND label_y >= tile_y AND label_y < tile_y + 1024
""", ("records",))
def tiles_holding_labels(spark, sf):
    return tl.tiles_holding_labels(v.records(spark, sf)).select("image_id", "tile_idx")


@query("tiles_meeting_line", f"""
SELECT image_id, CAST(tile_idx AS INTEGER) AS tile_idx FROM (
  SELECT *, line_a * tile_x + line_b * tile_y + line_c AS d0, line_a * 1023 AS dx, line_b * 1023 AS dy FROM ({FULL_GRID}))
WHERE line_a IS NULL OR (least(d0, d0 + dx, d0 + dy, d0 + dx + dy) <= 25 AND greatest(d0, d0 + dx, d0 + dy, d0 + dx + dy) >= -25)
""", ("records",))
def tiles_meeting_line(spark, sf):
    return tl.tiles_meeting_line(tl.tile_grid(v.records(spark, sf)), 25.0).select("image_id", "tile_idx")


CROP_SQL = """
SELECT image_id, label_x, label_y, line_a, lo_x + least(CAST(floor(ux * (hi_x - lo_x + 1)) AS BIGINT), hi_x - lo_x) AS crop_x,
  lo_y + least(CAST(floor(uy * (hi_y - lo_y + 1)) AS BIGINT), hi_y - lo_y) AS crop_y
FROM (
  SELECT *, CASE WHEN biased THEN CASE WHEN ax > bx THEN mx ELSE ax END ELSE 0 END AS lo_x,
    CASE WHEN biased THEN CASE WHEN ax > bx THEN mx ELSE bx END ELSE 2990 END AS hi_x,
    CASE WHEN biased THEN CASE WHEN ay > by_ THEN my ELSE ay END ELSE 0 END AS lo_y,
    CASE WHEN biased THEN CASE WHEN ay > by_ THEN my ELSE by_ END ELSE 1992 END AS hi_y
  FROM (
    SELECT *, label_x IS NOT NULL AND CAST(CAST('0x' || substr(md5('4/b:' || image_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 < 0.7 AS biased,
      CAST(CAST('0x' || substr(md5('4/x:' || image_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS ux,
      CAST(CAST('0x' || substr(md5('4/y:' || image_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS uy,
      greatest(CAST(ceil(label_x - 960) AS BIGINT), 0) AS ax, least(CAST(floor(label_x - 64) AS BIGINT), 2990) AS bx,
      greatest(CAST(ceil(label_y - 960) AS BIGINT), 0) AS ay, least(CAST(floor(label_y - 64) AS BIGINT), 1992) AS by_,
      greatest(0, least(CAST(trunc(label_x) AS BIGINT) - 512, 2990)) AS mx, greatest(0, least(CAST(trunc(label_y) AS BIGINT) - 512, 1992)) AS my
    FROM records))
"""


@query("crop_origins", f"SELECT image_id, crop_x, crop_y FROM ({CROP_SQL})", ("records",))
def crop_origins(spark, sf):
    return tl.crop_origin(v.records(spark, sf), seed=4).select("image_id", "crop_x", "crop_y")


@query("training_tiles", f"""
SELECT image_id, crop_x, crop_y, label_x - crop_x AS local_x, label_y - crop_y AS local_y,
  coalesce(label_x - crop_x >= 0 AND label_x - crop_x < 1024 AND label_y - crop_y >= 0 AND label_y - crop_y < 1024, false) AS presence,
  CASE wavelength WHEN 'red' THEN 1.0 WHEN 'green' THEN 0.0 ELSE 0.5 END AS colour_value
FROM ({CROP_SQL}) JOIN (SELECT image_id, wavelength, image_checksum FROM frames LEFT JOIN tags USING (dive_id)) USING (image_id)
WHERE image_id % 29 <> 0
""", ("records", "frames", "tags"), "local_x local_y colour_value")
def training_tiles(spark, sf):
    rec = v.records(spark, sf).join(v.tags(spark, sf).select("dive_id", "wavelength"), "dive_id", "left")
    there = v.frames(spark, sf).filter(F.col("image_id") % 29 != 0)
    return tl.training_tiles(rec, there, seed=4).select(
        "image_id", "crop_x", "crop_y", "local_x", "local_y", "presence", "colour_value")


@query("gaussian_targets", """
SELECT image_id, count(*) AS n_cells, sum(exp(-((tx - label_x) * (tx - label_x) + (ty - label_y) * (ty - label_y)) / 18.0)) AS mass
FROM (
  SELECT image_id, label_x, label_y, unnest(range(greatest(CAST(floor(label_x) AS BIGINT) - 9, 0), least(CAST(ceil(label_x) AS BIGINT) + 9, 2047) + 1)) AS tx, ty
  FROM (SELECT image_id, label_x, label_y, unnest(range(greatest(CAST(floor(label_y) AS BIGINT) - 9, 0), least(CAST(ceil(label_y) AS BIGINT) + 9, 2047) + 1)) AS ty
    FROM frames WHERE label_x >= 0 AND label_x < 2048 AND label_y >= 0 AND label_y < 2048))
GROUP BY image_id
""", ("frames",), "mass")
def gaussian_targets(spark, sf):
    cells = tl.gaussian_target(v.frames(spark, sf).select("image_id", "label_x", "label_y"), 2048, 2048,
                               x="label_x", y="label_y")
    return cells.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("target").alias("mass"))


@query("seeded_order", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('9:' || o_orderkey), o_orderkey) - 1 AS place FROM orders
""")
def seeded_order(spark, sf):
    from sightline.operators.ordering import token_ranked

    o = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return token_ranked(o, ["o_orderpriority"], token(9, "o_orderkey"), ["o_orderkey"], "place").select("o_orderkey", "place")
