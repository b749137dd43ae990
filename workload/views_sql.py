"""The same views, and the tables computed from them, as DuckDB SQL fragments.

These are written independently of the Spark operators: plain windows,
quantiles and joins on one machine.
"""

from __future__ import annotations

# name -> (names it needs, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTES[name] = (needs, sql.strip())


def with_ctes(needs: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with every fragment it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in CTES[name][0]:
            visit(parent)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{name} AS (\n{CTES[name][1]}\n)" for name in ordered)
    return f"WITH RECURSIVE {parts}\n{body.strip()}"


cte("geo", (), """
SELECT *, 1400 + slope * (lx - 1800) + noise + gross AS ly FROM (
  SELECT *,
    CASE WHEN user_id % 25 = 24 THEN event_id % 20 = 0 ELSE event_type <> 'error' END AS labelled,
    CASE WHEN user_id % 10 = 9 THEN 1500 + value * CAST(0.03 AS DOUBLE) ELSE 1200 + value * 4 END AS lx,
    CASE WHEN user_id % 10 = 9 THEN CAST(0 AS DOUBLE) ELSE CAST(user_id % 9 - 4 AS DOUBLE) / 8 END AS slope,
    CAST((event_id * 7919) % 401 AS DOUBLE) / 100 - 2 AS noise,
    CASE WHEN event_id % 41 = 0 AND user_id % 10 <> 9 THEN 60 ELSE 0 END AS gross
  FROM events)
""")
cte("frames", ("geo",), """
SELECT dive_id, image_id, rig_id, image_path, image_checksum, label_x, label_y,
       labelled AND NOT coalesce(superseded, false) AS is_positive, label_string,
       label_studio_task_id, label_studio_project_id, superseded, true AS completed
FROM (
  SELECT user_id AS dive_id, event_id AS image_id, user_id % 7 AS rig_id, labelled,
    'd' || user_id || '/' || event_id || '.png' AS image_path,
    md5(CAST(event_id AS VARCHAR)) AS image_checksum,
    CASE WHEN labelled THEN lx END AS label_x, CASE WHEN labelled THEN ly END AS label_y,
    CASE WHEN event_id % 31 = 0 THEN true WHEN event_id % 97 = 1 THEN NULL ELSE false END AS superseded,
    CASE WHEN user_id % 6 = 5 THEN NULL
         WHEN user_id % 6 < 3 THEN CASE WHEN event_id % 12 = 0 THEN 'Green dot' ELSE 'Red dot' END
         ELSE CASE WHEN event_id % 12 = 0 THEN 'red dot' ELSE 'dot-green' END END AS label_string,
    event_id + 1000000 AS label_studio_task_id, user_id % 3 AS label_studio_project_id
  FROM geo)
""")
cte("predictions", ("geo",), """
SELECT event_id AS image_id,
  CASE WHEN event_id % 19 <> 0 THEN lx + CAST((event_id * 104729) % 801 AS DOUBLE) / 160 - CAST(2.5 AS DOUBLE)
       + CASE WHEN event_id % 5 = 0 THEN 3 ELSE 0 END END AS pred_x,
  CASE WHEN event_id % 19 <> 0 THEN ly + CAST((event_id * 130363) % 801 AS DOUBLE) / 160 - CAST(2.5 AS DOUBLE)
       + CASE WHEN event_id % 43 = 0 THEN 600 ELSE 0 END END AS pred_y,
  CASE WHEN event_id % 19 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST((event_id * 15485863) % 700 + CASE WHEN labelled THEN 300 ELSE 0 END AS DOUBLE) / 1000
  END AS pred_confidence
FROM geo
""")
cte("colour_votes", ("frames",), r"""
SELECT dive_id,
  count(*) FILTER (WHERE regexp_matches(label_string, '\bred\b', 'i')) AS n_red,
  count(*) FILTER (WHERE regexp_matches(label_string, '\bgreen\b', 'i')) AS n_green,
  count(*) FILTER (WHERE regexp_matches(label_string, '\bblue\b', 'i')) AS n_blue
FROM frames WHERE is_positive GROUP BY dive_id
""")
cte("majority", ("colour_votes",), """
SELECT dive_id, n_red, n_green, n_blue,
  CASE WHEN n_red > n_green AND n_red > n_blue THEN 'red'
       WHEN n_green > n_red AND n_green > n_blue THEN 'green'
       WHEN n_blue > n_red AND n_blue > n_green THEN 'blue' END AS wavelength
FROM colour_votes
""")
cte("tags", ("majority",), """
SELECT d.dive_id, m.wavelength, CASE WHEN m.wavelength IS NOT NULL THEN 'label_string' END AS wavelength_source
FROM (SELECT DISTINCT dive_id FROM frames) d LEFT JOIN majority m USING (dive_id)
""")
cte("splits", ("tags",), """
SELECT dive_id, CASE WHEN r < n_train THEN 'train' WHEN r < n_train + n_val THEN 'val' ELSE 'test' END AS split
FROM (
  SELECT *, least(CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT), n - n_train) AS n_val FROM (
    SELECT *, CAST(round_even(n * CAST(0.8 AS DOUBLE), 0) AS BIGINT) AS n_train FROM (
      SELECT dive_id,
        row_number() OVER (PARTITION BY wavelength ORDER BY md5('0:' || dive_id), dive_id) - 1 AS r,
        count(*) OVER (PARTITION BY wavelength) AS n
      FROM tags)))
""")
cte("lsq_moments", ("frames",), """
SELECT dive_id, count(*) AS n, avg(label_x) AS mx, avg(label_y) AS my,
  var_pop(label_x) AS sxx, var_pop(label_y) AS syy, covar_pop(label_x, label_y) AS sxy
FROM frames WHERE is_positive GROUP BY dive_id
""")
cte("lsq_normal", ("lsq_moments",), """
SELECT *, -(a * mx + b * my) AS c,
  a * a * sxx + b * b * syy + 2 * a * b * sxy AS across,
  b * b * sxx + a * a * syy - 2 * a * b * sxy AS along
FROM (
  SELECT *, CASE WHEN cos(t) < 0 THEN sin(t) ELSE -sin(t) END AS a, abs(cos(t)) AS b
  FROM (SELECT *, 0.5 * atan2(2 * sxy, sxx - syy) AS t FROM lsq_moments))
""")
cte("lines", ("lsq_normal",), """
SELECT dive_id, n_positives, line_a, line_b, line_c, line_confidence,
  coalesce(line_confidence >= 5, false) AS is_line_confident
FROM (
  SELECT dive_id, n AS n_positives,
    CASE WHEN n >= 5 THEN a END AS line_a, CASE WHEN n >= 5 THEN b END AS line_b,
    CASE WHEN n >= 5 THEN c END AS line_c,
    CASE WHEN n >= 5 THEN CASE WHEN across <= 1e-9 THEN CAST('inf' AS DOUBLE) ELSE along / across END END
      AS line_confidence
  FROM lsq_normal)
""")
cte("per_frame", ("frames", "predictions", "splits", "tags", "lines"), """
SELECT f.*, s.split, w.wavelength, l.line_confidence, p.pred_x, p.pred_y, p.pred_confidence,
  sqrt((p.pred_x - f.label_x) * (p.pred_x - f.label_x) + (p.pred_y - f.label_y) * (p.pred_y - f.label_y)) AS raw_err
FROM frames f JOIN splits s USING (dive_id) LEFT JOIN tags w USING (dive_id)
LEFT JOIN (SELECT dive_id, line_confidence FROM lines) l USING (dive_id)
LEFT JOIN predictions p USING (image_id)
""")
cte("val_frame", ("per_frame",), "SELECT * FROM per_frame WHERE split = 'val'")
cte("pos", ("per_frame",), """
SELECT *, err > 3 AS fail FROM (
  SELECT *, pred_x IS NULL OR pred_y IS NULL AS no_pred,
    CASE WHEN pred_x IS NULL OR pred_y IS NULL THEN CAST('inf' AS DOUBLE) ELSE raw_err END AS err
  FROM per_frame WHERE is_positive)
""")
cte("priors", ("pos",), """
SELECT rig_id, wavelength, count(*) AS n_prior, quantile_cont(pred_x, 0.5) AS prior_x, quantile_cont(pred_y, 0.5) AS prior_y
FROM pos WHERE NOT fail AND NOT no_pred GROUP BY rig_id, wavelength
""")
cte("line_edges", ("pos",), """
SELECT quantile_cont(line_confidence, 0.25) AS e1, quantile_cont(line_confidence, 0.5) AS e2,
  quantile_cont(line_confidence, 0.75) AS e3 FROM pos
""")
cte("pos_prior", ("pos", "priors"), """
SELECT p.*, r.prior_x, r.prior_y,
  sqrt((label_x - prior_x) * (label_x - prior_x) + (label_y - prior_y) * (label_y - prior_y)) AS dist_from_prior
FROM pos p LEFT JOIN priors r ON p.rig_id = r.rig_id AND p.wavelength = r.wavelength
""")
cte("prior_edges", ("pos_prior",), """
SELECT quantile_cont(dist_from_prior, 0.25) AS d1, quantile_cont(dist_from_prior, 0.5) AS d2,
  quantile_cont(dist_from_prior, 0.75) AS d3 FROM pos_prior
""")
cte("enriched", ("pos_prior", "line_edges", "prior_edges"), """
SELECT *,
  CASE WHEN line_confidence IS NULL THEN 'none' WHEN line_confidence <= e1 THEN 'q1'
       WHEN line_confidence <= e2 THEN 'q2' WHEN line_confidence <= e3 THEN 'q3' ELSE 'q4' END AS line_q,
  CASE WHEN dist_from_prior IS NULL THEN 'none' WHEN dist_from_prior <= d1 THEN 'near_q1'
       WHEN dist_from_prior <= d2 THEN 'q2' WHEN dist_from_prior <= d3 THEN 'q3' ELSE 'far_q4' END AS prior_q,
  CASE WHEN NOT fail THEN 'hit' WHEN no_pred THEN 'presence_nopred'
       WHEN pred_confidence < 1 THEN 'presence_lowconf' ELSE 'localization' END AS fail_class,
  CASE WHEN NOT fail THEN 'hit' WHEN err <= 10 THEN 'borderline_3to10' WHEN err <= 50 THEN 'mid_10to50'
       WHEN err < CAST('inf' AS DOUBLE) THEN 'catastrophic_gt50' ELSE 'no_pred' END AS err_class
FROM pos_prior, line_edges, prior_edges
""")
# Consensus lines: numbered points, hashed pairs, votes, refit.
cte("points", ("frames",), """
SELECT dive_id, image_id, label_x AS x, label_y AS y,
  row_number() OVER (PARTITION BY dive_id ORDER BY md5('0:' || image_id), image_id) - 1 AS k,
  count(*) OVER (PARTITION BY dive_id) AS n
FROM frames WHERE is_positive
""")
cte("pairs", ("points",), """
SELECT q.dive_id, q.h, -(p1.y - p0.y) / norm AS a, (p1.x - p0.x) / norm AS b, p0.x AS x0, p0.y AS y0
FROM (
  SELECT dive_id, h, i, (i + 1 + (15485863 * h + dive_id) % (m - 1)) % m AS j FROM (
    SELECT dive_id, h, m, (7919 * h + 104729 * dive_id) % m AS i
    FROM (SELECT dive_id, any_value(n) AS m FROM points GROUP BY dive_id HAVING any_value(n) >= 5),
         (SELECT range AS h FROM range(200)))) q
JOIN points p0 ON p0.dive_id = q.dive_id AND p0.k = q.i
JOIN points p1 ON p1.dive_id = q.dive_id AND p1.k = q.j,
LATERAL (SELECT sqrt((p1.x - p0.x) * (p1.x - p0.x) + (p1.y - p0.y) * (p1.y - p0.y)) AS norm) z
WHERE norm > 0
""")
cte("votes", ("pairs",), """
SELECT c.dive_id, c.h, any_value(c.a) AS a, any_value(c.b) AS b, any_value(-(c.a * c.x0 + c.b * c.y0)) AS c,
  count(*) AS votes
FROM pairs c JOIN points p ON p.dive_id = c.dive_id
WHERE abs(c.a * p.x + c.b * p.y + -(c.a * c.x0 + c.b * c.y0)) < 4
GROUP BY c.dive_id, c.h
""")
cte("consensus", ("votes",), """
SELECT dive_id, h, a, b, c, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY dive_id ORDER BY votes DESC, h) AS place FROM votes) WHERE place = 1
""")
cte("refit", ("consensus",), """
SELECT dive_id, a, b, -(a * mx + b * my) AS c FROM (
  SELECT *, CASE WHEN cos(t) < 0 THEN sin(t) ELSE -sin(t) END AS a, abs(cos(t)) AS b FROM (
    SELECT *, 0.5 * atan2(2 * sxy, sxx - syy) AS t FROM (
      SELECT p.dive_id, avg(p.x) AS mx, avg(p.y) AS my, var_pop(p.x) AS sxx, var_pop(p.y) AS syy,
        covar_pop(p.x, p.y) AS sxy
      FROM points p JOIN consensus c ON p.dive_id = c.dive_id
      WHERE abs(c.a * p.x + c.b * p.y + c.c) < 4 GROUP BY p.dive_id)))
""")
cte("measured", ("refit",), """
SELECT p.dive_id, p.image_id, p.x, p.y, r.a, r.b, r.c, abs(r.a * p.x + r.b * p.y + r.c) AS d
FROM points p JOIN refit r ON p.dive_id = r.dive_id
""")
cte("mads", ("measured",), """
SELECT dive_id, quantile_cont(abs(d - med), 0.5) AS mad FROM (
  SELECT m.*, q.med FROM measured m JOIN (
    SELECT dive_id, quantile_cont(d, 0.5) AS med FROM measured GROUP BY dive_id) q USING (dive_id))
GROUP BY dive_id
""")
cte("fitted", ("measured", "mads", "points"), """
SELECT dive_id, n_positives, a AS line_a, b AS line_b, c AS line_c, inlier_count,
  CAST(inlier_count AS DOUBLE) / n_positives AS inlier_fraction, residual_std,
  CAST(1.4826 AS DOUBLE) * mad AS label_noise_mad, line_confidence,
  coalesce(line_confidence >= 5, false) AS is_line_confident
FROM (SELECT dive_id, count(*) AS n_positives FROM points GROUP BY dive_id)
LEFT JOIN (
  SELECT dive_id, a, b, c, count(*) FILTER (WHERE d < 4) AS inlier_count,
    stddev_pop(d) FILTER (WHERE d < 4) AS residual_std,
    CASE WHEN var_pop(a * x + b * y) FILTER (WHERE d < 4) <= 1e-9 THEN CAST('inf' AS DOUBLE)
      ELSE var_pop(a * y - b * x) FILTER (WHERE d < 4) / var_pop(a * x + b * y) FILTER (WHERE d < 4) END
      AS line_confidence
  FROM measured GROUP BY dive_id, a, b, c) USING (dive_id)
LEFT JOIN mads USING (dive_id)
""")
cte("flagged", ("frames", "fitted"), """
SELECT f.*, coalesce(f.is_positive AND l.is_line_confident AND l.label_noise_mad IS NOT NULL
    AND abs(line_a * label_x + line_b * label_y + line_c) > 3 * greatest(l.label_noise_mad, 1), false) AS label_is_outlier,
  abs(line_a * label_x + line_b * label_y + line_c) AS perp_distance_to_line
FROM frames f LEFT JOIN (
  SELECT dive_id, line_a, line_b, line_c, label_noise_mad, is_line_confident FROM fitted) l USING (dive_id)
""")
cte("records", ("frames", "lines"), """
SELECT f.dive_id, f.image_id, f.rig_id, f.label_x, f.label_y, f.is_positive, l.line_a, l.line_b, l.line_c,
  l.line_confidence, l.is_line_confident, 4014 AS width, 3016 AS height
FROM frames f LEFT JOIN lines l USING (dive_id)
""")
cte("candidates", (), """
SELECT event_id AS image_id, t AS tile_idx, ox AS tile_x, oy AS tile_y,
  (event_id * 31 + t * 17) % 1022 + 1 + dx AS x, (event_id * 57 + t * 29) % 1022 + 1 + dy AS y,
  CAST((event_id * 7919 + t * 104729) % 997 AS DOUBLE) / 125 - 4
    - CASE WHEN k = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((event_id + k * 31) % 17 + 1 AS DOUBLE) / 16 END AS logit,
  CAST((event_id * 15485863 + t * 7) % 1000 AS DOUBLE) / 1000 AS presence
FROM events,
  (VALUES (CAST(0 AS BIGINT), CAST(768 AS BIGINT), CAST(768 AS BIGINT)), (1, 1536, 768), (2, 768, 1536)) v(t, ox, oy),
  (VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)), (1, -1, 0), (2, 1, 0), (3, 0, -1), (4, 0, 1)) w(k, dx, dy)
""")
cte("gate", ("records",), """
SELECT image_id, width, height,
  CASE WHEN coalesce(is_line_confident, false) THEN line_a END AS line_a,
  CASE WHEN coalesce(is_line_confident, false) THEN line_b END AS line_b,
  CASE WHEN coalesce(is_line_confident, false) THEN line_c END AS line_c,
  CASE WHEN coalesce(is_line_confident, false) AND line_a IS NOT NULL THEN line_confidence ELSE CAST(0 AS DOUBLE) END AS line_confidence
FROM records
""")
cte("flips", (), """
SELECT md5(CAST(event_id AS VARCHAR)) AS image_checksum,
  CASE WHEN event_id % 29 <> 0 THEN CAST(([0, 3, 5, 6])[CAST(event_id % 4 + 1 AS INTEGER)] AS INTEGER) END AS flip
FROM events
""")
cte("rasters", (), """
SELECT event_id AS image_id, user_id AS dive_id, event_id % 100 = 7 AS large, CASE WHEN event_id % 100 = 7 THEN 88 ELSE 9 END AS w,
  CASE WHEN event_id % 100 = 7 THEN 82 ELSE 9 END AS h, event_id % CASE WHEN event_id % 100 = 7 THEN 88 ELSE 9 END AS cx,
  (event_id * 5) % CASE WHEN event_id % 100 = 7 THEN 82 ELSE 9 END AS cy FROM events
""")
cte("pixels", ("rasters",), """
SELECT image_id, x, y, CASE WHEN disc THEN 150 WHEN lit THEN weak ELSE 40 END AS b,
  CASE WHEN disc THEN 150 WHEN lit AND NOT red THEN tone WHEN lit THEN weak ELSE 30 END AS g,
  CASE WHEN disc THEN 220 WHEN lit AND red THEN tone WHEN lit THEN weak ELSE 20 END AS r
FROM (
  SELECT image_id, x, y, (image_id * 7 + x * y * 3 + x * 5 + y * 2) % 6 < 2
      AND (NOT large OR (x % 8 < 6 AND y % 7 < 5 AND (x // 8 + y // 7 + image_id) % 4 = 0)) AS lit,
    image_id % 300 = 7 AND (x - cx) * (x - cx) + (y - cy) * (y - cy) <= CASE WHEN image_id % 600 = 7 THEN 400 ELSE 144 END AS disc,
    205 + (image_id + x * 3 + y * 7) % 50 AS tone, dive_id % 6 < 3 AS red, 30 + (image_id + x + y) % 25 AS weak
  FROM rasters, unnest(range(h)) ys(y), unnest(range(w)) xs(x))
""")
cte("hsv", ("pixels",), """
SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS hue FROM (
  SELECT *,
    CAST(floor((diff * CASE WHEN v = 0 THEN 0 ELSE round_even(1044480.0 / v, 0) END + 2048) / 4096.0) AS BIGINT) AS sat,
    CAST(floor((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * diff ELSE r - g + 4 * diff END
      * CASE WHEN diff = 0 THEN 0 ELSE round_even(737280.0 / (6 * diff), 0) END + 2048) / 4096.0) AS BIGINT) AS h0
  FROM (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS diff FROM pixels))
""")
