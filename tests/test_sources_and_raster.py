"""Image scan and store, pixel operators, and the curation job end to end."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import schemas
from sightline.functions import pixel_arrays as pa_
from sightline.functions import pixels as px
from sightline.operators import image_blocks as ib
from sightline.operators import raster as ra
from sightline.operators import peaks as pk
from sightline.operators import tags as tg
from sightline.plans.breakdown import breakdown
from sightline.plans.curate import CurationSettings, curate
from sightline.plans.predict import Recipe, evaluate_classical, postprocess
from sightline.sources import images as im
from sightline.sources import tables as tb
from sightline.sources.loaded import load_images
from sightline.sources.scoring import score_tiles
from workload import views as v
from conftest import SF


def png(path, bgr):
    h, w, _ = bgr.shape
    raw = b"".join(b"\0" + bgr[y, :, ::-1].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def canvas(h=60, w=80, dots=()):
    img = np.empty((h, w, 3), np.uint8)
    img[:] = (40, 30, 20)
    ys, xs = np.mgrid[0:h, 0:w]
    for x, y, radius, bgr in dots:
        img[(xs - x) ** 2 + (ys - y) ** 2 <= radius**2] = bgr
    return img


def pixel_rows(spark, images):
    rows = []
    for image_id, img in images.items():
        for y in range(img.shape[0]):
            for x in range(img.shape[1]):
                rows.append((image_id, x, y, *[int(c) for c in img[y, x]]))
    return spark.createDataFrame(rows, schemas.PIXELS)


RED, GREEN = (30, 30, 255), (30, 255, 30)


def detect(spark, images, wavelength=None, line=None):
    frames = spark.createDataFrame([(i, 1) for i in images], "image_id bigint, dive_id bigint")
    tags = spark.createDataFrame([(1, wavelength)], "dive_id bigint, wavelength string")
    abc = line or (None, None, None)
    lines = spark.createDataFrame(
        [(1, *abc, line is not None)], "dive_id bigint, line_a double, line_b double, line_c double, is_line_confident boolean")
    return {r["image_id"]: r for r in ra.classical_predictions(frames, pixel_rows(spark, images), tags, lines).collect()}


def test_detector_colour_area_and_line(spark):
    images = {
        1: canvas(dots=[(30, 20, 3, RED)]),
        2: canvas(dots=[(30, 20, 3, GREEN)]),
        3: canvas(dots=[(30, 20, 0, RED)]),
        4: canvas(dots=[(30, 20, 3, RED), (60, 40, 3, (30, 30, 230))]),
        5: canvas(),
    }
    got = detect(spark, images, "red")
    assert (got[1]["pred_x"], got[1]["pred_y"]) == (30.0, 20.0) and got[1]["pred_confidence"] == 1.0
    assert got[2]["pred_x"] is None and got[2]["pred_confidence"] == 0.0
    assert got[3]["pred_x"] is None and got[5]["pred_x"] is None
    assert (got[4]["pred_x"], got[4]["pred_y"]) == (30.0, 20.0)
    near = detect(spark, {4: images[4]}, "red", (0.0, 1.0, -40.0))
    assert (near[4]["pred_x"], near[4]["pred_y"]) == (60.0, 40.0)


def test_components_join_diagonals_and_spirals(spark):
    rng = np.random.default_rng(2)
    mask = rng.random((24, 24)) < 0.45
    spiral = np.zeros((15, 15), bool)
    x = y = 0
    dx, dy, left, top, right, bottom = 1, 0, 0, 0, 14, 14
    for _ in range(120):
        spiral[y, x] = True
        if dx == 1 and x == right:
            dx, dy, top = 0, 1, top + 2
        elif dy == 1 and y == bottom:
            dx, dy, right = -1, 0, right - 2
        elif dx == -1 and x == left:
            dx, dy, bottom = 0, -1, bottom - 2
        elif dy == -1 and y == top:
            dx, dy, left = 1, 0, left + 2
        x, y = min(max(x + dx, 0), 14), min(max(y + dy, 0), 14)
    cases = {1: mask, 2: spiral}
    rows = [(i, int(c), int(r), 1) for i, m in cases.items() for r, c in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "image_id bigint, x bigint, y bigint, val int")
    got = {i: sorted(r["area"] for r in ra.blobs(ra.labelled_runs(df, ["image_id"]), ["image_id"]).filter(
        F.col("image_id") == i).collect()) for i in cases}
    for i, m in cases.items():
        todo, areas = {(int(r), int(c)) for r, c in zip(*np.nonzero(m))}, []
        while todo:
            stack, n = [todo.pop()], 0
            while stack:
                r, c = stack.pop()
                n += 1
                for p in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if p in todo:
                        todo.remove(p)
                        stack.append(p)
            areas.append(n)
        assert got[i] == sorted(areas)


def test_blob_under_label(spark):
    images = {1: canvas(dots=[(30, 20, 3, RED)]), 2: canvas(dots=[(30, 20, 3, RED)]), 3: canvas(dots=[(30, 20, 40, RED)])}
    rows = spark.createDataFrame([(i, *g.shape, g.tobytes()) for i, g in images.items()], "image_id long, height int, width int, n_channels int, data binary")
    points = spark.createDataFrame(
        [(1, 1, 30.4, 20.0), (1, 2, 50.0, 50.0), (1, 3, 30.0, 20.0)], "dive_id bigint, image_id bigint, label_x double, label_y double")
    for raster in (pixel_rows(spark, images), rows):
        got = ra.blob_under_label(points, raster).collect()
        assert [r["image_id"] for r in got] == [1] and got[0]["blob_pixels"] == 29


def test_several_labels_of_one_image(spark):
    pixels = pixel_rows(spark, {1: canvas(dots=[(30, 20, 3, RED)])})
    schema = "dive_id bigint, image_id bigint, label_x double, label_y double, is_positive boolean"
    points = spark.createDataFrame([(1, 1, 30.4, 20.0, True), (1, 1, 29.0, 21.0, True), (1, 1, 30.1, 20.2, True)], schema)
    got = ra.blob_under_label(points, pixels).collect()
    assert [(r["image_id"], r["blob_pixels"]) for r in got] == [(1, 29)] * 3
    tags = tg.brightest_in_patch(points, pixels)
    assert tags.count() == 3
    gate = pk.line_gate(v.records(spark, SF).unionByName(v.records(spark, SF)))
    assert gate.count() == gate.select("image_id").distinct().count()
    records = v.records(spark, SF)
    twice = records.unionByName(records.filter("image_id % 9 = 0"))
    assert postprocess(v.candidates(spark, SF), twice).count() == twice.count()


def test_image_scan_store_and_pixels(spark, tmp_path):
    root, store, orc = tmp_path / "img", str(tmp_path / "store"), str(tmp_path / "orc")
    root.mkdir()
    for i in range(3):
        png(root / f"{i}.png", canvas(6, 5, [(2, 2, 1, RED)]))
    (root / "broken.png").write_bytes(b"not an image")
    frames = spark.createDataFrame(
        [(i, f"{i}.png", f"{i}abc") for i in range(3)] + [(7, "broken.png", "7abc"), (8, "gone.png", "8abc")],
        "image_id bigint, image_path string, image_checksum string")
    loaded = im.attach_images(frames, im.scan_images(spark, str(root)))
    for spelled in (f"file:{root}", f"file://{root}/"):
        assert {r[0] for r in im.scan_images(spark, spelled).select("image_path").collect()} == {"0.png", "1.png", "2.png"}
    assert loaded.count() == 5 and loaded.filter("data is null").count() == 2
    pixels = im.pixel_table(loaded)
    assert pixels.count() == 3 * 30
    assert pixels.filter("image_id = 1 and x = 2 and y = 2").first()[3:] == RED
    assert im.null_images(frames).filter("data is null").count() == 5


def test_store_decodes_once(spark, tmp_path):
    """A second run calls no loader; a run that died is done again; other paths are tried if the first fails."""
    calls, dot = tmp_path / "calls", canvas(6, 5, [(2, 2, 1, RED)])
    calls.mkdir()

    def load(path, checksum):
        (calls / f"{checksum}-{path.replace('/', '_')}-{np.random.default_rng().integers(1 << 60)}").touch()
        if path.startswith("bad"):
            raise OSError("gone")
        return None if path.startswith("none") else dot

    rows = [(i, f"p{i}", f"{i:02d}abc") for i in range(20)]
    rows += [(20, "p0", "00abc"), (21, "zz", "01abc"), (30, "bad", "90abc"), (31, "none", "91abc"), (32, "bad2", "92abc"), (33, "p9", "92abc")]
    frames = spark.createDataFrame(rows, "image_id bigint, image_path string, image_checksum string")
    store = im.ImageStore(spark, str(tmp_path / "store"))

    def report(**options):
        seen = len(list(calls.iterdir()))
        got = {r["status"]: (r["n"], r["attempts"]) for r in im.warm_report(im.warm_store(frames, store, load, **options)).collect()}
        return got, len(list(calls.iterdir())) - seen

    assert report(run="a") == ({"decoded": (21, 22), "failed": (2, 2)}, 24)
    assert report() == ({"warm": (21, 0), "failed": (2, 2)}, 2)
    assert report(retry_failed=False) == ({"warm": (21, 0), "failed": (2, 0)}, 0)
    assert store.images().count() == 21
    # Images whose run has no manifest rows are as if not there.
    import shutil
    for attempt in (0, 1):
        shutil.rmtree(tmp_path / "store" / "manifest" / f"part=a-{attempt}")
    assert store.images().count() == 0
    assert report(run="a")[0] == {"decoded": (21, 22), "failed": (2, 2)}
    assert store.images().count() == 21 == store.images().select("image_checksum").distinct().count()
    orc = im.ImageStore(spark, str(tmp_path / "orc"), "orc")
    assert tuple(im.reencode_store(store, orc).first()) == (21, 0, 0)
    assert tuple(im.reencode_store(store, orc).first()) == (0, 21, 0)
    same = store.images().join(orc.images().withColumnRenamed("data", "other"), "image_checksum")
    assert same.filter("data = other").count() == 21
    with pytest.raises(Exception):
        im.warm_store(frames.withColumn("image_checksum", F.lit("")), store, load).count()
    assert im.warm_store(frames.limit(0), store, load).count() == 0


def test_loader_keeps_missing_images(spark):
    wanted = v.frames(spark, SF).select("image_path", "image_checksum").unionByName(
        spark.createDataFrame([(None, "x")], "image_path string, image_checksum string"))
    got = load_images(wanted, v.render, 3)
    assert got.rdd.getNumPartitions() == 3
    n = v.frames(spark, SF).select("image_path").distinct().count()
    missing = v.frames(spark, SF).filter("image_id % 37 = 5").count()
    assert got.count() == n and got.filter("data is null").count() == missing > 0
    assert load_images(wanted.limit(0), v.render).count() == 0
    back = v.frames(spark, SF).join(got, ["image_path", "image_checksum"], "left")
    same = back.filter("data is not null").join(v.rasters(spark, SF).withColumnRenamed("data", "other"), "image_id")
    assert same.filter("data <> other").count() == 0


def test_pixel_arrays_match_expressions(spark):
    """The Arrow pass and the column expressions agree on every pixel."""
    rng = np.random.default_rng(6)
    bgr = np.concatenate([rng.integers(0, 256, (6_000, 3)), [[0, 0, 0], [255, 255, 255], [9, 9, 9]]]).astype(np.uint8)
    rows = [(i, *map(int, c)) for i, c in enumerate(bgr)]
    cols = (F.col("b"), F.col("g"), F.col("r"))
    parts = px.hsv(*cols)
    got = spark.createDataFrame(rows, "i long, b long, g long, r long").select(
        "i", parts.hue.cast("long"), parts.sat.cast("long"), parts.val, px.audit_mask(*cols),
        *[px.colour_mask(*cols, F.lit(t)) for t in ("red", "green", "")]).orderBy("i").collect()
    hue, sat, val = pa_.hsv_arrays(bgr)
    masks, _ = pa_.tag_masks(bgr)
    audit = pa_.audit_mask_array(bgr)
    for i, r in enumerate(got):
        assert tuple(r)[1:] == (hue[i], sat[i], val[i], audit[i], masks["red"][i], masks["green"][i], masks[""][i])


def test_labelled_runs_of_masks(spark):
    """Array labels against the pixel-row operator, on noise, blanks and full masks."""
    rng = np.random.default_rng(7)
    masks = np.stack([rng.random((13, 17)) < p for p in (0.0, 0.2, 0.4, 0.5, 0.7, 1.0)])
    runs = pa_.labelled_runs_of(masks)
    got = sorted(zip(runs.image.tolist(), np.bincount(runs.label, runs.length, len(runs))[runs.label].astype(int).tolist()))
    rows = [(int(i), int(x), int(y), 1) for i, y, x in zip(*np.nonzero(masks))]
    df = ra.labelled_runs(spark.createDataFrame(rows, "image_id bigint, x bigint, y bigint, val int"), ["image_id"])
    area = df.groupBy("image_id", "label").agg(F.sum("area").alias("n"))
    expected = df.join(area, ["image_id", "label"]).select("image_id", "n").collect()
    assert got == sorted(map(tuple, expected))
    assert len(pa_.labelled_runs_of(np.zeros((0, 3, 3), bool))) == 0


def test_tables_and_logs(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert tb.read_or_compute(spark, path, compute, force=force).count() == 3
    assert len(calls) == 2
    assert tb.read_optional(spark, str(tmp_path / "none")) is None
    run = tb.log_run(spark, str(tmp_path / "runs"), {"lr": 0.1, "git": "x"})
    metrics = spark.createDataFrame([("overall", "hit_rate_n3", 0.5)], "slice string, metric string, value double")
    for step in (0, 1, 0):
        tb.log_metrics(metrics, str(tmp_path / "metrics"), run, step)
    assert tb.read_metrics(spark, str(tmp_path / "metrics")).filter(F.col("run_id") == run).count() == 2
    for value in (0.1, 0.2):
        tb.log_run(spark, str(tmp_path / "runs"), {"lr": value, "git": "x"}, "again")
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted(tuple(r) for r in runs.filter("run_id = 'again'").select("key", "value").collect()) == [("git", "x"), ("lr", "0.2")]
    assert runs.filter(F.col("run_id") == run).count() == 2


def test_parse_records(spark):
    rows = [
        (1, '{"k": 5, "x": 1.5}'), (2, '{"k": "7", "x": null}'), (3, '{"k": "many", "x": 1}'), (4, '{"x": 2}'), (5, '{"k": 1'),
        (6, "plain"), (7, None), (8, '{"k": 99999999999999999999}'), (9, ""), (10, "[1]")]
    raw = spark.createDataFrame([(i, i % 3, p, "kept") for i, p in rows], "id long, source long, payload string, k string")
    got = tb.parse_records(raw, "payload", {"k": "bigint", "x": "double"}, ["k"])
    assert got.columns == ["id", "source", "k", "x", "problem"]
    problems = {r["id"]: (r["k"], r["x"], r["problem"]) for r in got.collect()}
    assert problems[1] == (5, 1.5, None) and problems[2] == (7, None, None)
    assert problems[3][2] == problems[8][2] == "malformed:k" and problems[4][2] == "missing:k"
    assert all(problems[i][2] in ("unreadable", "missing:k") for i in (5, 6, 7, 9, 10)) and problems[5][2] == "unreadable"
    bad = {r["source"]: r["n_bad"] for r in tb.failed_keys(got, "source").collect()}
    assert bad == {0: 3, 1: 3, 2: 2}


def test_tile_crops(spark):
    """Crops against slices; an image smaller than the tile is reflected; missing images have no crop."""
    rng = np.random.default_rng(3)
    big, small, grey = rng.integers(0, 256, (20, 30, 3)), rng.integers(0, 256, (5, 4, 3)), rng.integers(0, 256, (20, 20, 1))
    rows = [(i, *g.shape, g.astype(np.uint8).tobytes()) for i, g in ((1, big), (2, small), (3, grey))] + [(4, None, None, None, None)]
    images = spark.createDataFrame(rows, "image_id long, height int, width int, n_channels int, data binary")
    tiles = spark.createDataFrame([(1, 5, 2), (1, 22, 12), (2, 0, 0), (3, 12, 12), (4, 0, 0), (5, 0, 0)], "image_id long, crop_x long, crop_y long")
    got = {(r["image_id"], r["crop_x"]): np.frombuffer(r["crop"], np.uint8).reshape(8, 8, 3) for r in ib.tile_crops(tiles, images, 8).collect()}
    assert len(got) == 4
    assert (got[1, 5] == big[2:10, 5:13]).all() and (got[1, 22] == big[12:20, 22:30]).all()
    assert (got[2, 0] == small[[0, 1, 2, 3, 4, 3, 2, 1]][:, [0, 1, 2, 3, 2, 1, 0, 1]]).all()
    assert (got[3, 12] == grey[12:20, 12:20]).all()


def test_cell_features(spark):
    # One cell: R 500, G1 700, G2 600, B 300, black 100 each.
    sites = spark.createDataFrame(
        [(1, 0, 0, 500), (1, 1, 0, 700), (1, 0, 1, 600), (1, 1, 1, 300)], "image_id bigint, x bigint, y bigint, value bigint")
    row = ra.cell_features(sites, black=(100,) * 4).first()
    assert (row["g_excess"], row["r_excess"], row["g_diff"]) == (150, 0, 100)
    assert ra.upsample_cells(ra.cell_features(sites), 2, 1).count() == 2


def test_curation_job(spark, tmp_path):
    out = str(tmp_path / "curated")
    tables = curate(spark, v.dives(spark, SF), v.images(spark, SF), v.labels(spark, SF), out, CurationSettings(image_order="seq"))
    assert tables["frames"].filter("image_path LIKE 'old/%'").isEmpty()
    assert tables["frames"].schema == schemas.FRAMES
    n = tables["frames"].select("dive_id").distinct().count()
    assert tables["splits"].count() == n == tables["tags"].count()
    assert tables["flagged"].count() == tables["frames"].count()
    again = curate(spark, v.dives(spark, SF).limit(0), v.images(spark, SF), v.labels(spark, SF), out, CurationSettings(image_order="seq"))
    assert again["splits"].count() == n
    with pytest.raises(ValueError):
        CurationSettings(train_frac=0.95)


def test_breakdown_and_recipes(spark):
    report = breakdown(v.joined(spark, SF))
    total = report["axes"].filter("axis = 'err_class'").agg(F.sum("n")).first()[0]
    assert total == v.positives(spark, SF).count()
    rec = v.records(spark, SF)
    out = postprocess(v.candidates(spark, SF).filter("image_id % 2 = 0"), rec, Recipe(snap=True, subpixel=True, bias_x=0.1),
                      intrinsics=v.intrinsics(spark))
    assert out.count() == rec.count()
    assert out.filter("image_id % 2 = 1 and (pred_x is not null or pred_confidence <> 0)").count() == 0


def test_classical_evaluation(spark):
    m = evaluate_classical(v.pixel_frames(spark, SF), v.pixels(spark, SF), v.splits(spark, SF), v.tags(spark, SF), v.lines(spark, SF))
    assert m.filter("slice = 'overall' and metric = 'n_frames'").count() == 1


def test_scorer_hook(spark):
    import pandas as pd

    def scorer(batches):
        for b in batches:
            yield pd.DataFrame({
                "image_id": b.image_id, "tile_idx": b.tile_idx.astype("int64"), "tile_x": b.tile_x, "tile_y": b.tile_y,
                "x": 5, "y": 6, "logit": 1.5, "presence": 0.5})

    from sightline.operators.tiles import tile_grid

    tiles = tile_grid(v.sized_images(spark, SF))
    assert score_tiles(tiles, scorer).count() == tiles.count()
