import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions.geometry import with_extent
from terraframe.operators import patches, polygon
from terraframe.plans import pipeline, runs
from terraframe.sources import geotiff, mosaics, vectors


def image(folder, name, a, x=600000.0, y=700000.0, res=1.0, nodata=-9.0):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(geotiff.encode(a.astype(np.float32), res, x, y, 2157, nodata))


def test_mosaics(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 90, (20, 30)), rng.integers(100, 190, (15, 25))
    b[3:6, 2:9] = -9  # nodata never covers
    image(tmp_path / "t", "a.tif", a)
    image(tmp_path / "t", "b&.tif", b, 600020.0, 699990.0)
    at = mosaics.mosaic_of_folder(spark, str(tmp_path / "t"), "m.vrt")
    assert at == str(tmp_path / "m.vrt") and "&amp;" in open(at).read()
    s = mosaics.read_mosaic(spark, at)
    assert {(r.seq, r.path.rpartition("/")[2], r.x_min, r.y_max, r.width, r.height) for r in s.collect()} == {(0, "a.tif", 600000.0, 700000.0, 30, 20), (1, "b&.tif", 600020.0, 699990.0, 25, 15)}
    whole = np.full((25, 45), np.nan)
    whole[:20, :30] = a
    at_b = whole[10:25, 20:45]
    np.copyto(at_b, b, where=b != -9)
    for tile, halo in ((7, 0), (16, 3)):
        seen = set()
        for r in mosaics.mosaic_tiles(s, tile, halo).collect():
            v = np.array(r["values"]).reshape(r["rows"], r["cols"])
            want = np.pad(whole, 60, constant_values=np.nan)[60 + r.tr * tile - halo:, 60 + r.tc * tile - halo:][:tile + 2 * halo, :tile + 2 * halo]
            assert np.array_equal(v, want, equal_nan=True) and r.x_min == 600000 + r.tc * tile and r.y_max == 700000 - r.tr * tile
            seen.add((r.tr, r.tc))
        assert seen >= {(r // tile, c // tile) for r, c in zip(*np.nonzero(~np.isnan(whole)), strict=True)}
    meta = geotiff.scan_metadata(geotiff.list_rasters(spark, str(tmp_path / "t")))
    with pytest.raises(ValueError, match="at least one"):
        mosaics.write_mosaic(meta.limit(0), str(tmp_path / "n.vrt"))
    image(tmp_path / "t", "c.tif", a, res=0.5)
    with pytest.raises(ValueError, match="one resolution"):
        mosaics.mosaic_of_folder(spark, str(tmp_path / "t"), "o.vrt")
    assert mosaics.mosaic_tiles(s.limit(0), 8).count() == 0


def disc(n, r, c, radius):
    y, x = np.mgrid[:n, :n]
    return ((y - r) ** 2 + (x - c) ** 2 <= radius**2).astype(float)


def own(image_, label):
    return image_[..., 0] * (1.0 if label == "AO" else 0.0)


def corners(image_, label):
    r, c = np.nonzero(image_[..., 0] > 0.9)
    return (np.array([[c.min(), r.min(), c.max() + 1, r.max() + 1]], float), np.array([0.75])) if len(r) and label == "AO" else (np.zeros((0, 4)), np.zeros(0))


@pytest.mark.parametrize(("kind", "model", "least"), [("segmentation", own, 0.8), ("object detection", corners, None)])
def test_a_run_from_files_to_files(spark, tmp_path, kind, model, least):
    a = disc(64, 20, 20, 9) + disc(64, 45, 40, 2)
    a[60:, 60:] = -9
    image(tmp_path / "in", "dem.tif", a)
    p = pipeline.RunParameters(ml_type=kind, labels=("AO", "barrow"), vis_exist_ok=True, roundness=least, min_area=20.0, save_vis=True, save_ml_output=True)
    out, log = runs.run(spark, geotiff.list_rasters(spark, str(tmp_path / "in")), p, str(tmp_path / "out"), model, 32, "dem")
    cols = "label string, area double, prediction_path string" + (", roundness double" if kind == "segmentation" else ", score double")
    got = vectors.read_gpkg(spark, out, out.rpartition("/")[2], cols).collect()
    assert got and all(r.label == "AO" and r.area > 20 and r.prediction_path.count("/") == 2 for r in got)
    if kind == "segmentation":
        assert len(got) == 1 and got[0].area == disc(64, 20, 20, 9).sum() and got[0].roundness > 0.8
    names = {f.name for f in (tmp_path / "out").rglob("*") if f.is_file()}
    assert {"tile_000000_dem.tif", "tile_000003_dem.tif", "tiled_image.vrt"} <= names and any(n.endswith("bounding_boxes.txt" if kind != "segmentation" else "_AO.tif") for n in names)
    for want in ("Processing log - ", "Image log:", "image size: 64x64 pixels", "CRS: EPSG:2157", "tiles count: 4", "> barrow", "Minimum area [m^2]: 20.0", "Save RAW results: YES", "TOTAL TIME: "):
        assert want in log.text
    assert ("roundness" in log.text) == (kind == "segmentation")
    # nothing kept, nothing found
    out, log = runs.run(spark, geotiff.list_rasters(spark, str(tmp_path / "in")), p.updated(save_vis=False, save_ml_output=False, min_area=1e6), str(tmp_path / "none"), model, 32)
    assert out == "" and "Save RAW results: NO" in log.text and not [f for f in (tmp_path / "none").rglob("*") if f.is_file()]


def test_runs_are_checked_first(spark, tmp_path):
    image(tmp_path / "in", "dem.tif", np.full((8, 8), -9.0))
    rasters = geotiff.list_rasters(spark, str(tmp_path / "in"))
    p = pipeline.RunParameters(ml_type="segmentation", labels=("AO",), custom_model_pth=str(tmp_path / "no.tar"))
    with pytest.raises(ValueError, match="no model"):
        runs.run(spark, rasters, p, str(tmp_path / "o"), own)
    with pytest.raises(ValueError, match="kind and labels"):
        runs.run(spark, rasters, pipeline.RunParameters(labels=("AO",)), str(tmp_path / "o"), own)
    out, log = runs.run(spark, rasters, p.updated(custom_model_pth=None), str(tmp_path / "o"), own, 8)
    assert out == "" and "tiles count: 0" in log.text


def test_log():
    log = runs.RunLog("A run", started=0.0)
    log.note("begun")
    log.section("inference", {"roundness": None, "area": 40, "kept": False, "classes": ["a", "b"]}, 90.0)
    lines = log.text.split("\n")
    assert "roundness" not in log.text and "    area: 40" in lines and "    kept: NO" in lines and "      > b" in lines and "TIME: 1.5 min" in lines and "Inference log:" in lines
    assert lines[3] == "Processing log - " + time.strftime("%d/%m/%Y %H:%M:%S", time.localtime(0)) and lines[5].endswith("] begun")
    assert runs.size_text(2048) == "2.00 kB" and runs.size_text(3 << 20) == "3.00 MB" and runs.size_text(5 << 29) == "2.50 GB"


def test_bands_and_older_boxes(spark, tmp_path):
    assert runs.three_bands(np.ones((2, 3, 1))).shape == (2, 3, 3) and runs.three_bands(np.ones((2, 3, 3))).shape == (2, 3, 3)
    image(tmp_path / "i", "x.y.tif", np.ones((4, 4)))
    texts = runs.legacy_box_texts(runs.tile_images(spark, str(tmp_path / "i")), lambda a: (np.array([[0.5, 1.5, 2.5, 3.4]]), np.array([3]), np.array([0.25])))
    assert [tuple(r) for r in texts.collect()] == [("x.txt", "0 2 2 3 ringfort 0.25\n")]
    none = runs.box_texts(runs.tile_images(spark, str(tmp_path / "i")), ("AO",), lambda a, label: (np.zeros((0, 4)), np.zeros(0)))
    assert [tuple(r) for r in none.collect()] == [("AO/x.y_AO_bounding_boxes.txt", "")]


def test_training_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.uniform(-0.5, 1.5, (40, 40))
    image(tmp_path / "in", "dem.tif", a, 0.0, 40.0)
    tiles = spark.createDataFrame([(1, 10.0, 10.0, 30.0, 30.0, 1.0)], "patch_id long, minx double, miny double, maxx double, maxy double, res double")
    seg = with_extent(spark.createDataFrame([(5, "barrow", 2, "POLYGON ((12 12, 20 12, 20 20, 12 20, 12 12))")], "seg_id long, arch_type string, dfm int, geometry string")).withColumn("rings", polygon.wkt_rings(F.col("geometry")))
    shown = patches.shown_segments(tiles, seg, 16.0)
    lines = patches.label_texts(patches.label_lines(patches.relative_bounds(shown), "r_arch_type", "r_dfm"), "patch_id", "r_seg_id")
    rows = tiles.join(lines, "patch_id").selectExpr("*", "'images/p.tif' as images_path", "'masks/p.tif' as segmentation_masks_path", "'labelTxt/p.txt' as labeltxt_path", f"'{tmp_path / 'in' / 'dem.tif'}' as path")
    done = runs.training_files(rows, shown.selectExpr("*", "0 as band", "r_seg_id as seq", "r_dfm as dfm"), str(tmp_path / "out")).collect()
    assert {r.kind for r in done} == {"image", "mask", "labels"}
    assert (tmp_path / "out/labelTxt/p.txt").read_text() == "2 10 10 10 10 18 2 18 barrow 2"
    v = {r.path.split("/")[-2]: np.array(r["values"]).reshape(r["rows"], r["cols"], r["bands"]) for r in runs.tile_images(spark, str(tmp_path / "out")).collect()}
    mask = np.zeros((20, 20, 3))
    mask[10:18, 2:10, 0] = 2
    assert np.array_equal(v["masks"], mask) and np.allclose(v["images"][..., 0], np.clip(a[10:30, 10:30], 0, 1))
