"""Plans and sizes of intermediate data that must follow the input."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import image_blocks as ib
from sightline.operators import lines as ln
from sightline.operators import peaks as pk
from sightline.operators import raster as ra
from sightline.sources import loaded as ld

CANDIDATE = "image_id bigint, tile_idx bigint, tile_x bigint, tile_y bigint, x bigint, y bigint, logit double, presence double"


def literal(spark, rows, schema: str):
    """Rows whose small size Catalyst knows."""
    names, kinds = zip(*(c.rsplit(" ", 1) for c in schema.split(", ")))
    cells = ", ".join("(" + ", ".join("null" if v is None else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t({', '.join(names)})").select(
        *[F.col(n).cast(k) for n, k in zip(names, kinds)])


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def cells(spark):
    """A peak at (5, 6) of tile 0 with its four neighbours, a lower cell in tile 1, and cells without image or tile."""
    around = [(5, 6, 2.0), (4, 6, 1.0), (6, 6, 1.5), (5, 5, 1.0), (5, 7, 1.0)]
    rows = [(i, 0, 10, 20, x, y, v, 0.5) for i in (1, 2) for x, y, v in around]
    rows += [(1, 1, 100, 20, 3, 3, 1.9, 0.7), (None, 0, 10, 20, 5, 6, 9.0, 0.9), (2, None, 10, 20, 5, 6, -9.0, 0.1)]
    return literal(spark, rows, CANDIDATE)


@pytest.fixture()
def gate(spark):
    record = "image_id bigint, width int, height int, line_a double, line_b double, line_c double, line_confidence double, is_line_confident boolean"
    return pk.line_gate(spark.createDataFrame([(i, 400, 300, None, None, None, None, False) for i in (1, 2)], record))


def test_candidates_are_not_broadcast(spark, cells, gate):
    best = pk.best_peaks(cells, gate)
    refined = pk.refine_subpixel(best, cells)
    for df, joins in ((best, 1), (refined, 2)):
        plan = plan_of(df)
        assert plan.count("SortMergeJoin [image_id") >= joins
    got = {r["image_id"]: r for r in refined.collect()}
    assert {(r["tile_idx"], r["x"], r["y"]) for r in got.values()} == {(0, 5, 6)}
    bend = 1.0 - 2 * 2.0 + 1.5
    assert got[1]["shift_x"] == pytest.approx(0.5 * (1.0 - 1.5) / bend) and got[1]["shift_y"] == 0.0
    assert got[1]["presence"] == 0.7


def test_soft_argmax_needs_no_join(spark, cells):
    soft = pk.soft_argmax(cells)
    assert "Join" not in plan_of(soft)
    got = {(r["image_id"], r["tile_idx"]): r for r in soft.collect()}
    assert set(got) == {(1, 0), (2, 0), (1, 1)}
    w = {1.0: math.exp(-1.0), 1.5: math.exp(-0.5), 2.0: 1.0}
    total = 3 * w[1.0] + w[1.5] + w[2.0]
    assert got[1, 0]["soft_x"] == pytest.approx(10 + (5 * w[2.0] + 14 * w[1.0] + 6 * w[1.5]) / total)
    assert (got[1, 1]["soft_x"], got[1, 1]["soft_y"]) == (103.0, 23.0)


def test_votes_of_small_and_large_dives(spark, monkeypatch):
    """One large dive in many parts, many small ones in one part each, one without any usable pair, one of unknown dive."""
    rng = np.random.default_rng(5)
    rows, image = [], 0
    for dive, n in ((0, 900), (1, 30), (2, 5), (3, 4), (None, 20)):
        for t in rng.uniform(0, 1000, n):
            rows.append((dive, image, float(t), float(0.3 * t + rng.normal(0, 3)), True))
            image += 1
    rows += [(4, image + i, 7.0, 8.0, True) for i in range(6)]
    f = spark.createDataFrame(rows, "dive_id bigint, image_id bigint, label_x double, label_y double, is_positive boolean")
    once = {r["dive_id"]: r for r in ln.consensus_lines(f, hypotheses=40).collect()}
    monkeypatch.setattr(ln, "VOTERS_PER_PART", 100)
    cut = {r["dive_id"]: r for r in ln.consensus_lines(f, hypotheses=40).collect()}
    assert once == cut and set(cut) == {0, 1, 2, 4} and cut[4]["h"] is None and cut[4]["votes"] is None
    for dive in (0, 1, 2):
        at = np.array([(x, y) for d, _, x, y, _ in rows if d == dive])
        order = sorted((hashlib.md5(f"0:{i}".encode()).hexdigest(), x, y) for d, i, x, y, _ in rows if d == dive)
        m, votes = len(order), []
        for h in range(40):
            first = (7919 * h + 104729 * dive) % m
            (_, x0, y0), (_, x1, y1) = order[first], order[(first + 1 + (15485863 * h + dive) % (m - 1)) % m]
            a, b = -(y1 - y0), x1 - x0
            votes.append(int((np.abs(a * (at[:, 0] - x0) + b * (at[:, 1] - y0)) / math.hypot(a, b) < ln.INLIER_TOL_PX).sum()))
        assert (cut[dive]["votes"], cut[dive]["h"]) == (max(votes), votes.index(max(votes)))


def brute_blobs(mask: np.ndarray) -> list[int]:
    todo, areas = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, []
    while todo:
        stack, n = [todo.pop()], 0
        while stack:
            y, x = stack.pop()
            n += 1
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
            todo -= near
            stack += near
        areas.append(n)
    return sorted(areas)


def raster_of(mask: np.ndarray) -> np.ndarray:
    return np.where(mask[:, :, None], np.array([30, 30, 230]), 40).astype(np.uint8)


def test_blobs_of_pixels_and_strips_without_rounds(spark, monkeypatch):
    """Images below a band's height need no rounds; pixels that come twice count twice, rows without image not at all."""
    def no_rounds(*_):
        raise AssertionError("a small image must not be labelled in rounds")

    monkeypatch.setattr(ra, "component_labels", no_rounds)
    rng = np.random.default_rng(8)
    masks = {i: rng.random((20, 15)) < 0.4 for i in (1, 2)}
    rows = [(i, int(x), int(y), 7) for i, m in masks.items() for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows + [r for r in rows if r[0] == 2] + [(None, 1, 1, 7)], "image_id bigint, x bigint, y bigint, val int")
    got = ra.blobs(ra.labelled_runs(df, ["image_id"]), ["image_id"]).collect()
    for i, times in ((1, 1), (2, 2)):
        assert sorted(r["area"] for r in got if r["image_id"] == i) == [times * n for n in brute_blobs(masks[i])]
    assert {r["image_id"] for r in got} == {1, 2}
    strips = [(i, top, 5, 15, 3, raster_of(m)[top:top + 5].tobytes()) for i, m in masks.items() for top in range(0, 20, 5)]
    images = spark.createDataFrame(strips, "image_id bigint, top int, height int, width int, n_channels int, data binary")
    found = ra.image_blobs(images).filter("tag = 'red'").collect()
    for i, m in masks.items():
        assert sorted(r["area"] for r in found if r["image_id"] == i) == brute_blobs(m)


@pytest.mark.parametrize("height", [5, 50])
def test_blobs_across_bands(spark, monkeypatch, height):
    monkeypatch.setattr(ib, "BAND_ROWS", 8)
    mask = np.random.default_rng(9).random((50, 12)) < 0.42
    mask[:, 3] = True
    rows = [(1, int(x), int(y), 7) for y, x in zip(*np.nonzero(mask))]
    df = spark.createDataFrame(rows, "image_id bigint, x bigint, y bigint, val int")
    got = ra.blobs(ra.labelled_runs(df, ["image_id"]), ["image_id"]).collect()
    assert sorted(r["area"] for r in got) == brute_blobs(mask)
    strips = [(1, top, height, 12, 3, raster_of(mask)[top:top + height].tobytes()) for top in range(0, 50, height)]
    images = spark.createDataFrame(strips, "image_id bigint, top int, height int, width int, n_channels int, data binary")
    found = ra.image_blobs(images).filter("tag = 'red'").collect()
    assert sorted(r["area"] for r in found) == brute_blobs(mask)


def test_loaded_batches_are_bounded_in_rows():
    image = np.zeros((2, 2, 3), np.uint8)
    pairs = ((f"p{i}", f"c{i}") for i in range(2 * ld.BATCH_ROWS + 5))
    batches = list(ld.load_rows(lambda path, checksum: image, pairs))
    assert [b.num_rows for b in batches] == [ld.BATCH_ROWS, ld.BATCH_ROWS, 5]
    assert [b.column("image_path")[0].as_py() for b in batches] == ["p0", f"p{ld.BATCH_ROWS}", f"p{2 * ld.BATCH_ROWS}"]
