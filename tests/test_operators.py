import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraframe.functions import scalars as S
from terraframe.functions.geometry import with_extent
from terraframe.operators import archive, boxes, grid, metrics, patches, polygon, proximity, raster, spatial
from terraframe.plans import pipeline
from tests import brute


def got(df):
    return {tuple(r) for r in df.collect()}


# ---- geometry and scalars


def test_extent_of_every_way_of_writing(spark):
    same = ["POLYGON ((1 2, 3.5 2, 3.5 4, 1 4, 1 2))", "SRID=2157;POLYGON((1 2,3.5 2,3.5 4,1 4,1 2))", "polygon (( 1.0  2.0 , 3.50  2 , 3.5 4 , 1 4 ))",
            "POLYGON Z ((1 2 0, 3.5 2 0, 3.5 4 9, 1 4 0))", "MULTIPOLYGON (((1.0E+00 2.0E+00, 3.5E+00 4.0E+00, 1 4)))"]
    df = spark.createDataFrame([(i, g, 7.0) for i, g in enumerate([*same, None, "POLYGON EMPTY", "", "POINT (5 -6)"])], "id int, geometry string, minx double")
    out = {r.id: (r.minx, r.miny, r.maxx, r.maxy) for r in with_extent(df).collect()}
    assert all(out[i] == (1.0, 2.0, 3.5, 4.0) for i in range(5))
    assert all(out[i] == (None,) * 4 for i in (5, 6, 7)) and out[8] == (5.0, -6.0, 5.0, -6.0)


def test_rounding_and_text(spark):
    xs = [0.5, 1.5, 2.5, 3.5, 1.25, 1.15, 0.35, 1.45, 0.50004, 0.00005, 2.675, 1e9 + 0.25]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (1, 2, 4):
        assert [r[0] for r in df.select(S.printed(F.col("x"), d)).collect()] == [f"{x:.{d}f}" for x in xs]
    assert [r[0] for r in df.select(S.half_even(F.col("x"))).collect()] == [round(x) for x in xs]
    odd = spark.createDataFrame([(None,), (float("nan"),), (0.50004,), (0.5001,)], "s double")
    assert [r[0] for r in odd.select(S.is_confident(F.col("s"))).collect()] == [False, False, False, True]
    names = spark.createDataFrame([("a/b/c/d.tif",), ("d.tif",), (None,)], "p string")
    assert [tuple(r) for r in names.select(S.path_tail(F.col("p")), S.stem(F.col("p")), S.before_first_dot(F.lit("x.y.z"))).collect()] == [("b/c/d.tif", "d", "x"), ("d.tif", "d", "x"), (None, None, "x")]


def test_nodata_kinds(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, None), (1.0, nan), (1.0, 1.0), (nan, None), (None, 1.0), (2.0, 1.0)], "z double, nodata double")
    assert raster.valid_pixels(df, "nodata").count() == 3
    assert [r[0] for r in df.select(S.unit_clamped(F.col("z"), F.col("nodata"))).collect()] == [1.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_nodata_of_every_raster(spark, data):
    from terraframe import queries

    kinds = {r.raster_id: r.nodata for r in spark.read.parquet(f"{data}/raster.parquet").collect()}
    out = {r.raster_id: (r.n_pix, r.n_valid) for r in queries.nodata_kinds(spark, data).collect()}
    assert set(out) == set(kinds) and sum(n for n, _ in out.values()) == queries.pixels(spark, data).count()
    for k, v in kinds.items():
        assert (out[k][0] == out[k][1]) == (v is None or math.isnan(v))  # each number takes pixels away


# ---- proximity


def test_points_near_each_other(spark):
    rng = np.random.default_rng(1)
    pts = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-100, 100, (400, 2)))] + [(900, 0.0, 0.0), (901, 0.0, 0.0), (902, 0.0, 25.0), (902, 0.0, 25.0)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pts] + [(None, 1.0, 1.0, "x", 1), (903, None, 1.0, "x", 1), (904, float("nan"), 1.0, "x", 1)], "pid long, px double, py double, id string, salt int")
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 625}
    assert got(proximity.near_pairs(df, "pid", "px", "py", 25.0)) == want
    assert got(proximity.near_pairs(df, "pid", "px", "py", 25.0, hot_cell=2)) == want
    assert proximity.near_pairs(df.limit(0), "pid", "px", "py", 25.0).count() == 0
    with pytest.raises(ValueError, match="metric"):
        proximity.near_pairs(df, "pid", "px", "py", 1.0, metric="taxi")


def test_great_circle_over_pole_and_date_line(spark):
    pts = [(1, 179.99, 10.0), (2, -179.99, 10.0), (3, 0.0, 89.999), (4, 180.0, 89.999), (5, 20.0, 20.0), (6, 20.0, 20.02)]

    def far(a, b):
        x1, y1, x2, y2 = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * proximity.EARTH_RADIUS_M * math.asin(math.sqrt(h))

    df = spark.createDataFrame(pts, "id long, x double, y double")
    for radius in (300.0, 2300.0, 2.1e7):
        want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and far(a, b) <= radius}
        assert got(proximity.near_pairs(df, "id", "x", "y", radius, metric="great_circle")) == want


def test_regions_that_hold_points(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-50, 50, (200, 2)))]
    reg = [(1000 + i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(-50, 50, (60, 4)) * [1, 1, 1, 1] % [97, 97, 40, 40] - [50, 50, 0, 0])]
    p = spark.createDataFrame([*pts, (None, 0.0, 0.0), (999, None, 0.0), pts[0]], "pid long, x double, y double")
    r = spark.createDataFrame([*reg, (5000, None, 0.0, 1.0, 1.0), (5001, 3.0, 3.0, 1.0, 1.0), reg[0]], "rid long, minx double, miny double, maxx double, maxy double")
    want = {(a, b) for a, x, y in pts for b, x0, y0, x1, y1 in reg if x0 <= x <= x1 and y0 <= y <= y1}
    assert got(proximity.points_in_regions(p, "pid", "x", "y", r, "rid")) == want
    assert got(proximity.points_in_regions(p, "pid", "x", "y", r, "rid", hot_cell=3)) == want
    assert proximity.points_in_regions(p, "pid", "x", "y", r.limit(0), "rid").count() == 0
    tri = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)])], "rid long, minx double, miny double, maxx double, maxy double, ring array<struct<x: double, y: double>>")
    q = spark.createDataFrame([(1, 2.0, 2.0), (2, 8.0, 8.0)], "pid long, x double, y double")
    assert got(proximity.points_in_regions(q, "pid", "x", "y", tri, "rid", ring="ring")) == {(1, 1)}


def test_rect_join(spark):
    rng = np.random.default_rng(3)
    box = lambda n: [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(0, 60, (n, 4)) % [60, 60, 9, 9] - [30, 30, 0, 0])]
    a, b = box(80), box(70)
    da, db = (spark.createDataFrame([*v, (99, None, 0.0, 1.0, 1.0)], "id long, minx double, miny double, maxx double, maxy double") for v in (a, b))
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    out = spatial.rect_join(da, db, 7.0).select("id", "r_id").collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want
    assert got(spatial.rect_semi_join(da, db, ["id"], 7.0).select("id")) == {(i,) for i, _ in want}


# ---- archive


def test_archive_round_trip(spark):
    files = [(1, "a/x.txt", "é\n1 2"), (2, "a/x.txt", ""), (3, None, "abc"), (4, "b", None), (5, "c", "z" * 5000), (6, "c", "abc")]
    df = spark.createDataFrame([(*f, "p") for f in files], "file_id long, file_path string, content string, payload string")
    blocks = archive.pack(df, path="file_path", block_bytes=100).cache()
    back = archive.unpack(blocks).collect()
    assert sorted((r.file_id, r.path, None if r.content is None else bytes(r.content).decode()) for r in back) == files
    assert all(r.intact for r in back)
    assert archive.archive_index(blocks).filter("length is null").count() == 1
    one = archive.lookup(blocks, spark.createDataFrame([("c",)], "path string")).collect()
    assert sorted(r.file_id for r in one) == [5, 6]
    spoiled = blocks.withColumn("payload", F.expr("cast(repeat('q', length(payload)) as binary)"))
    assert not any(r.intact for r in archive.unpack(spoiled).collect() if r.content)
    assert archive.unpack(archive.pack(df.limit(0), path="file_path")).count() == 0


def test_archive_of_many_tiny_partitions(spark, tmp_path):
    df = spark.range(0, 2000, 1, 200).selectExpr("id as file_id", "concat('f', id) as path", "if(id % 7 = 0, null, rpad(cast(id as string), 50, 'x')) as content").cache()
    total = df.selectExpr("sum(length(content))").first()[0]
    blocks = archive.write_archive(df, str(tmp_path / "a"), block_bytes=10_000).cache()
    sizes = [r[0] for r in blocks.selectExpr("length(payload)").collect()]
    assert math.ceil(total / 10_000) <= len(sizes) <= math.ceil(total / 9_000) + 1 and max(sizes) <= 10_000
    assert len(list((tmp_path / "a").glob("*.parquet"))) <= len(sizes) + 1  # Spark may add one without rows
    back = archive.unpack(blocks)
    assert got(back.selectExpr("file_id", "path", "cast(content as string)", "intact")) == got(df.selectExpr("file_id", "path", "content", "true")) and back.count() == 2000
    assert blocks.select("block_id").distinct().count() == len(sizes)


def test_box_lines(spark):
    ok = "1 2 3 4 AO 0.5 2157 0.5 6.0 7"
    texts = [None, "", "\ufeff" + ok + "\r\n\r\n" + ok.replace(" ", "\t"), " " + ok + "  \n" + ok + " 9\n" + ok.replace("0.5", "n/a", 1), "x0 y0 x1 y1 label score epsg res x_min y_max\n1e0 2.0 3 4 ao .5 2157 5e-1 6 7.00"]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    assert got(archive.box_lines(df).select("file_id", "line_no")) == {(2, 1), (2, 3), (3, 1), (4, 2)}
    kept = archive.distinct_boxes(archive.box_lines(df)).collect()
    assert [(r.file_id, r.line_no, r.copies, r.label) for r in kept] == [(2, 1, 4, "AO")]


def test_found_queries_against_brute_force(spark, data):
    from terraframe import queries

    assert got(queries.p1_found(spark, data)) == brute.near(data)
    assert got(queries.p3_found(spark, data)) == brute.records(data)


# ---- rasters


def test_relief_tiled_is_global(spark):
    rng = np.random.default_rng(4)
    z = rng.integers(0, 1000, (70, 45)).astype(float)
    z[10:25, 5:30] = np.nan
    df = spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else int(z[r, c])) for r in range(70) for c in range(45)], "r long, c long, z long")
    a = {(r.r, r.c): r.relief for r in raster.local_relief(df, 4).collect()}
    b = {(r.r, r.c): r.relief for r in raster.local_relief_tiled(df, 4, 16).collect()}
    for (r, c), v in a.items():
        w = z[max(0, r - 4): r + 5, max(0, c - 4): c + 5]
        if v is None:
            assert math.isnan(z[r, c])
        else:
            assert v == pytest.approx(z[r, c] - np.nanmean(w)) == b[(r, c)]


def test_components_and_outlines(spark):
    rng = np.random.default_rng(5)
    m = rng.random((40, 33)) < 0.5
    r, c = np.nonzero(m)
    first = raster.label_components(r, c)
    g = brute.Groups()
    at = {(a, b): k for k, (a, b) in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    for (a, b), k in at.items():
        g.find(k)
        for n in ((a + 1, b), (a, b + 1)):
            if n in at:
                g.join(k, at[n])
    assert first.tolist() == [g.find(k) for k in range(len(r))]
    assert len(set(raster.label_components(c, r).tolist())) == len(set(first.tolist()))
    for part in set(first.tolist()):
        rings = raster.outline(r[first == part], c[first == part])
        assert abs(sum(float(np.dot(x[:-1, 0], x[1:, 1]) - np.dot(x[1:, 0], x[:-1, 1])) / 2 for x in map(np.array, rings))) == (first == part).sum()
    two = spark.createDataFrame([(0, 0), (1, 1)], "r long, c long")
    assert raster.components(two, 8, 8).select("part").distinct().count() == 2
    assert raster.components(two.limit(0), 8, 8).count() == 0


def test_roundness_anchors():
    y, x = np.mgrid[-41:42, -41:42]
    r, c = np.nonzero(x**2 + y**2 <= 1600)
    corners = (np.concatenate([c, c + 1, c, c + 1]).astype(float), np.concatenate([r, r, r + 1, r + 1]).astype(float))
    assert 4 * math.pi * len(r) / raster.hull_perimeter(*corners) ** 2 == pytest.approx(0.9746, abs=1e-3)
    assert 4 * math.pi * 9 / raster.hull_perimeter(np.array([0.0, 3, 3, 0]), np.array([0.0, 0, 3, 3])) ** 2 == pytest.approx(math.pi / 4)


def ringed(spark, rows):
    """(id, wkt) rows with their rings."""
    return spark.createDataFrame(rows, "id long, geometry string").select("id", polygon.wkt_rings(F.col("geometry")).alias("rings"), F.lit(0.5).alias("minx"), F.lit(0.5).alias("miny"), F.lit(3.0).alias("maxx"), F.lit(3.0).alias("maxy"))


def test_polygon_area_and_clip(spark):
    texts = {
        1: "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", 2: "MULTIPOLYGON ( ((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)) )", 3: "POLYGON EMPTY", 4: None, 5: "POINT (1 1)",
        6: "SRID=2157;POLYGON Z ((0 0 9, 4 0 9, 4 1 9, 1 1 9, 1 4 9, 0 4 9))", 7: "POLYGON ((8 8, 9 8, 9 9, 8 8))", 8: "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", 9: "POLYGON ((-9 -9, 9 -9, 9 9, -9 9, -9 -9))"}
    df = ringed(spark, list(texts.items()))
    area = {r.id: r.area for r in polygon.with_measures(df, "rings").collect()}
    assert area == {1: 96.0, 2: 1.0, 3: None, 4: None, 5: None, 6: 7.0, 7: 0.5, 8: 1.0, 9: 324.0}
    cut = {r.id: (r.whole, r.part, r.px0, r.py0, r.px1, r.py1) for r in polygon.with_clip(df, "rings", ("minx", "miny", "maxx", "maxy")).collect()}
    assert cut[1] == (96.0, 6.25 - 1, 0.5, 0.5, 3.0, 3.0) and cut[2] == (1.0, 0.125, 0.5, 0.5, 1.0, 1.0)
    assert cut[3] == cut[4] == cut[5] == (0.0, 0.0, None, None, None, None) and cut[7] == (0.5, 0.0, None, None, None, None)
    assert cut[6] == pytest.approx((7.0, 0.5 * 2.5 + 0.5 * 2.0, 0.5, 0.5, 3.0, 3.0)) and cut[8] == (1.0, 1.0, 1.0, 1.0, 2.0, 2.0) and cut[9] == (324.0, 6.25, 0.5, 0.5, 3.0, 3.0)
    assert polygon.with_clip(df.limit(0), "rings", ("minx", "miny", "maxx", "maxy")).count() == 0


def star(rng, corners, centre, size):
    at, far = np.sort(rng.uniform(0, 2 * np.pi, corners)), rng.uniform(0.3, 1, corners) * size
    return np.column_stack([centre[0] + far * np.cos(at), centre[1] + far * np.sin(at)])


def batch(p):
    kind = pa.list_(pa.struct([("outer", pa.bool_()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64()))]))
    return polygon.edges(pa.array([[{"outer": True, "x": p[:, 0].tolist(), "y": p[:, 1].tolist()}]], kind))


def test_touched_pixels_are_those_with_a_share():
    rng = np.random.default_rng(1)
    for t in range(150):
        p = star(rng, rng.integers(3, 12), rng.uniform(-2, 14, 2), rng.uniform(0.5, 8))
        e = batch(np.round(p) if t % 3 == 0 else p)
        if polygon.areas(e, 1)[0] < 1e-9:
            continue
        r0, c0, m = polygon.touched(e.x1, e.y1, e.x2, e.y2, 12, 10)
        hit = np.zeros((12, 10), bool)
        hit[r0:r0 + m.shape[0], c0:c0 + m.shape[1]] = m
        want = np.array([[polygon.areas_within(e, np.array([[j, i, j + 1, i + 1]], float))[0] > 1e-10 for j in range(10)] for i in range(12)])
        assert (hit == want).all()


def test_clip_adds_up_and_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(40):
        e = batch(star(rng, rng.integers(3, 12), rng.uniform(0, 12, 2), rng.uniform(2, 8)))
        whole = sum(polygon.areas_within(e, np.array([[x, y, x + 4, y + 4]], float))[0] for x in range(-12, 28, 4) for y in range(-12, 28, 4))
        assert whole == pytest.approx(polygon.areas(e, 1)[0])
        box = polygon.bounds_within(e, np.array([[2.0, 3.0, 9.0, 8.0]]))[0]
        share = np.array([(x, y) for x in np.arange(2.05, 9, 0.1) for y in np.arange(3.05, 8, 0.1) if polygon.areas_within(e, np.array([[x - 0.05, y - 0.05, x + 0.05, y + 0.05]]))[0] > 1e-9]).reshape(-1, 2)
        if len(share):
            assert np.abs(np.concatenate([share.min(0) - 0.05, share.max(0) + 0.05]) - box).max() < 0.13


def test_grids(spark):
    r = spark.createDataFrame([(1, 0.5, 10.0, 100.0, 8, 9), (2, 1.0, 0.0, 0.0, 0, 5), (3, None, 0.0, 0.0, 4, 4)], "raster_id long, res double, x_min double, y_max double, width int, height int")
    g = sorted(got(grid.bounding_grid(r, 4)))
    assert len(g) == 2 * 3 and g[0] == (1, 0, 10.0, 98.0, 12.0, 100.0) and g[-1] == (1, 5, 12.0, 94.0, 14.0, 96.0)
    t = sorted(got(grid.bounding_grid(r, 8, tag=True)))
    assert t[0][2:] == (8.0, 96.0, 12.0, 100.0)
    assert grid.staggered_grid(r, 8, 4).count() == 2 * len(t)


def test_outline_touch_keeps_tile(spark):
    assert got(grid.outline_tiles(spark.createDataFrame([(8, 3)], "r long, c long"), 8)) == {(1, 0), (0, 0)}
    assert got(grid.outline_tiles(spark.createDataFrame([(4, 4)], "r long, c long"), 8)) == {(0, 0)}


# ---- boxes


def test_parts_touching(spark):
    # overlap, shared edge, corner only, apart, no area
    b = [(1, 1, 0.6, 0, 0, 4, 4), (1, 2, 0.7, 3, 3, 6, 6), (1, 3, 0.9, 6, 4, 8, 6), (1, 4, 0.95, 8, 6, 9, 9), (1, 5, 0.8, 20, 20, 21, 21), (1, 6, 0.99, 30, 30, 30, 35), (2, 1, 0.5, 0, 0, 1, 1)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in b], "file_id double, box_no double, score double, minx double, miny double, maxx double, maxy double")
    m = boxes.parts(df, "file_id").cache()
    assert got(m.select("file_id", "box_no", "part")) == {(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (1, 5, 5), (2, 1, 1)}
    f = {(r.file_id, r.part): r for r in boxes.part_features(df, "file_id", geometry=True).collect()}
    assert {k: r.score for k, r in f.items()} == {(1, 1): 0.95, (1, 4): 0.95, (1, 5): 0.8, (2, 1): 0.5}
    assert {k: r.area for k, r in f.items()} == {(1, 1): 16 + 9 - 1 + 4, (1, 4): 3.0, (1, 5): 1.0, (2, 1): 1.0}
    assert f[2, 1].geometry == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))" and f[1, 1].n_boxes == 3 and f[1, 1].maxx == 8.0
    assert f[1, 1].geometry == "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 3.0, 6.0 3.0, 6.0 4.0, 8.0 4.0, 8.0 6.0, 3.0 6.0, 3.0 4.0, 0.0 4.0, 0.0 0.0))"  # corners only
    assert boxes.part_features(df.limit(0), "file_id").count() == 0
    assert boxes.parts(df.limit(0), "file_id").count() == 0
    assert boxes.at_least(df, "score", 0.7).count() == 4 and boxes.at_least(df, "score", None).count() == 7


def test_masks_in_the_patches_own_pixels(spark):
    # patch 1: 600 m wide, 100 m high at 0.5 m; patch 2: 40 m at 0.25 m; patch 3 has no resolution
    box = lambda x0, y0, x1, y1: [[True, [x0, x1, x1, x0], [y0, y0, y1, y1]]]
    b = [
        (1, 0, 1, 2, box(10.2, 98.0, 11.6, 99.0), 0.0, 0.0, 600.0, 100.0, 0.5), (1, 0, 2, 3, box(590.0, 1.0, 605.0, 5.0), 0.0, 0.0, 600.0, 100.0, 0.5),
        (2, 1, 3, 1, box(-3.0, 39.0, 1.0, 40.0), 0.0, 0.0, 40.0, 40.0, 0.25), (2, 1, 4, 4, box(0.5, 39.9, 0.6, 40.0), 0.0, 0.0, 40.0, 40.0, 0.25),
        (3, 0, 5, 1, box(0.0, 0.0, 1.0, 1.0), 0.0, 0.0, 1.0, 1.0, None), (2, 7, 6, 1, box(0.0, 0.0, 1.0, 1.0), 0.0, 0.0, 40.0, 40.0, 0.25)]
    df = spark.createDataFrame(b, "patch_id long, band int, seq long, dfm int, r_rings array<struct<outer:boolean,x:array<double>,y:array<double>>>, minx double, miny double, maxx double, maxy double, res double")
    got_ = {r.patch_id: np.frombuffer(bytes(r.mask), np.uint8).reshape(r.n_rows, r.n_cols, 3) for r in patches.burn_masks(df).collect()}
    want = {1: np.zeros((200, 1200, 3), int), 2: np.zeros((160, 160, 3), int)}
    want[1][2:4, 20:24, 0], want[1][190:198, 1180:1200, 0], want[2][0:4, 0:4, 1], want[2][0, 2, 1] = 2, 3, 1, 4
    assert got_.keys() == want.keys() and all((got_[k] == want[k]).all() for k in want)
    sums = {(k, int(j), int(v), int((m[..., j] == v).sum()), int(np.nonzero(m[..., j] == v)[0].sum()), int(np.nonzero(m[..., j] == v)[1].sum())) for k, m in want.items() for j in range(3) for v in np.unique(m[..., j]) if v}
    assert got(patches.mask_sums(df)) == sums
    assert patches.burn_masks(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="classes"):
        patches.class_bands(["a", "b", "c", "d"])


def mask_rows(spark, n, px):
    """A square of 4 m in each of n patches of px * px half-metre pixels."""
    rows = [(p, p % 3, p, p % 5 + 1, [[True, [1.0, 5.0, 5.0, 1.0], [1.0, 1.0, 5.0, 5.0]]], 0.0, 0.0, px / 2, px / 2, 0.5) for p in range(n)]
    return spark.createDataFrame(rows, "patch_id long, band int, seq long, dfm int, r_rings array<struct<outer:boolean,x:array<double>,y:array<double>>>, minx double, miny double, maxx double, maxy double, res double")


def python_steps(spark, monkeypatch):
    """The (input, function) of each Python step that is planned from now on."""
    found, kind = [], type(spark.range(1))
    for name in ("mapInArrow", "mapInPandas"):
        def call(self, f, *a, real=getattr(kind, name), **k):
            found.append((self, f))
            return real(self, f, *a, **k)

        monkeypatch.setattr(kind, name, call)
    return found


def test_masks_leave_their_task_a_few_at_a_time(spark, monkeypatch):
    steps = python_steps(spark, monkeypatch)
    patches.burn_masks(mask_rows(spark, 60, 512))
    rows, paint = steps[0]
    sizes, ids = [], []
    for b in paint(iter(rows.toArrow().combine_chunks().to_batches())):  # all patches come in one batch
        sizes.append(b.nbytes)
        ids += b.column(0).to_pylist()
    assert sorted(ids) == list(range(60)) and max(sizes) < 16 << 20
    steps.clear()
    patches.burn_masks(mask_rows(spark, 2, 2048))  # each larger than what leaves at once
    rows, paint = steps[0]
    assert [b.num_rows for b in paint(iter(rows.toArrow().combine_chunks().to_batches()))] == [1, 1]


def test_mask_files_send_no_mask_through_the_engine(spark, data, monkeypatch):
    from terraframe import queries

    steps = python_steps(spark, monkeypatch)
    queries.mask_files(spark, data)
    assert steps and not [c for df, _ in steps for c, t in df.dtypes if t == "binary"]


def test_masks_as_files(spark, tmp_path):
    from terraframe.plans import runs
    from terraframe.sources import geotiff

    df = mask_rows(spark, 20, 1100)  # taller than what is read back at once
    want = {r.patch_id: np.frombuffer(bytes(r.mask), np.uint8).reshape(r.n_rows, r.n_cols, 3) for r in patches.burn_masks(df).collect()}
    files = runs.write_masks(df, f"{tmp_path}/m", 2157).collect()
    assert sorted(r.patch_id for r in files) == sorted(want) and all((tmp_path / "m" / f"{r.patch_id}.tif").stat().st_size == r.n_bytes for r in files)
    for r in files:
        with geotiff.open_file(r.path) as f:
            h = geotiff.header(f)
            assert geotiff.metadata(r.path, h)[1:8] == (2157, 0.5, 0.0, 550.0, 1100, 1100, 3)
            assert np.array_equal(geotiff.read_window(f, h, 0, 1100, 0, 1100), want[r.patch_id])
    paths = {r.path: r.patch_id for r in files}
    counts = {(paths[r.path], r.band, r.v, r.n) for r in runs.band_values(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert counts == {(p, p % 3, p % 5 + 1, 64) for p in range(20)}


def test_label_corners_start_at_the_top_left(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0, 1.0)], "patch_id long, minx double, miny double, maxx double, maxy double, res double")
    s = with_extent(spark.createDataFrame([(1, "AO", 3, "POLYGON ((10 60, 30 60, 30 90, 10 90, 10 60))"), (2, "AO", 3, "POLYGON ((90 60, 110 60, 90 90, 90 60))")], "seg_id long, arch_type string, dfm int, geometry string"))
    shown = patches.shown_segments(p, s.withColumn("rings", polygon.wkt_rings(F.col("geometry"))), 50.0)
    lines = {r.r_seg_id: r.line for r in patches.label_lines(patches.relative_bounds(shown), "r_arch_type", "r_dfm").collect()}
    # the triangle's part in the patch: 3/4 of it, from x 90 to 100
    assert lines == {1: "10 10 30 10 30 40 10 40 AO 3", 2: "90 10 100 10 100 40 90 40 AO 3"}


def test_fraction_is_strict(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0, 1.0)], "patch_id long, minx double, miny double, maxx double, maxy double, res double")
    s = with_extent(spark.createDataFrame([(1, "a", None, "POLYGON ((-67 0, 33 0, 33 10, -67 10))"), (2, "b", 2, "POLYGON ((-66 0, 34 0, 34 10, -66 10))"), (3, "c", 3, "POLYGON ((100 100, 110 100, 110 110, 100 110))"), (4, "d", 3, "POINT (5 5)")], "seg_id long, arch_type string, dfm int, geometry string"))
    shown = patches.shown_segments(p, s.withColumn("rings", polygon.wkt_rings(F.col("geometry"))), 50.0)
    assert [r.r_seg_id for r in shown.collect()] == [2]
    line = patches.label_lines(patches.relative_bounds(shown), "r_arch_type", "r_dfm").first().line
    assert line == "0 90 34 90 34 100 0 100 b 2"


def test_boxes_of_all_sizes_meet_without_many_rows(spark):
    rng = np.random.default_rng(8)
    v = np.column_stack([rng.uniform(-3000, 3000, (150, 2)), 10 ** rng.uniform(-1, 4.5, (150, 2))])
    v[:5, 2:] = 0
    b = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(v)] + [(900, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(b, "id long, minx double, miny double, maxx double, maxy double")
    want = {(p[0], q[0]) for p in b[:-1] for q in b[:-1] if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    out = spatial.rect_join(df, df, 1.0, mixed=True).select("id", "r_id").collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want
    huge = spark.createDataFrame([(1, 0.0, 0.0, 1e7, 1e7)], "id long, minx double, miny double, maxx double, maxy double")
    assert spatial.rect_join(huge, df, 1.0, mixed=True).filter("r_id < 900").count() == sum(q[3] >= 0 and q[4] >= 0 for q in b[:-1])


def test_iou_and_precision(spark):
    px = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True), ("b", False, False)], "k string, t boolean, p boolean")
    assert got(metrics.pixel_iou(px, "k", "t", "p")) == {("a", 1, 1, 1, 1 / 3), ("b", 0, 0, 0, None)}
    pred = spark.createDataFrame([(1, "x", 0.9, 0.0, 0.0, 10.0, 10.0), (2, "x", 0.8, 0.0, 0.0, 10.0, 9.0), (3, "x", 0.7, 50.0, 50.0, 60.0, 60.0)], "id long, label string, score double, minx double, miny double, maxx double, maxy double")
    truth = spark.createDataFrame([(1, "x", 0.0, 0.0, 10.0, 10.0), (2, "x", 50.0, 50.0, 60.0, 60.0), (3, "y", 0.0, 0.0, 1.0, 1.0)], "id long, label string, minx double, miny double, maxx double, maxy double")
    ap = {r.label: (r.hits, round(r.ap, 6)) for r in metrics.average_precision(pred, truth, 20.0).collect()}
    assert ap == {"x": (2, round((1 + 2 / 3) / 2, 6)), "y": (0, 0.0)}


# ---- runs


def test_parameters():
    p = pipeline.RunParameters(ml_type="segmentation", labels=("AO",), dem_path="a/b.tif")
    assert p.updated(roundness=0.5, nonsense=3).roundness == 0.5 and p.output_folder == "a" and p.model_labels == ("AO",)
    assert p.updated(custom_model_pth="m.tar").model_labels == ("custom",)
    for bad in ({"ml_type": "other"}, {"roundness": 2.0}, {"min_area": -1.0}, {"ml_model_custom": "Custom model"}):
        with pytest.raises(ValueError, match=r"."):
            p.updated(**bad)
    assert pipeline.duration(90) == "1.5 min" and pipeline.duration(9.04) == "9.0 sec"


def test_pipelines(spark):
    from terraframe import queries

    d = "/root/testdata/sf0.001"
    params = pipeline.RunParameters(ml_type="segmentation", labels=("AO", "barrow"), roundness=0.5, min_area=0.3)
    f = pipeline.segmentation(queries.holed(spark, d), params, 1.0, 64, 64, 10_000.0)
    assert {r.label for r in f.select("label").distinct().collect()} == {"AO", "barrow"} and f.filter("roundness <= 0.5 or area <= 0.3").count() == 0
    od = pipeline.object_detection(queries.box_records(spark, d), params.updated(ml_type="object detection", min_area=400.0))
    assert od.count() > 0 and od.filter("area <= 400").count() == 0
    tp = pipeline.training_patches(queries.table(spark, d, "raster"), queries.segs(spark, d))
    assert tp.count() > 0 and tp.filter("labeltxt = ''").count() == 0
    assert pipeline.training_patches(queries.table(spark, d, "raster"), queries.segs(spark, d).limit(0)).count() == 0


def test_stages_are_written_and_cleared(spark):
    from terraframe import plans

    plans.clear_stages(spark)
    a = plans.stage(spark.range(10).toDF("k"), "t")
    assert a.count() == 10 and plans.shared_dir(spark) in a.inputFiles()[0]
    assert plans.clear_stages(spark) == 1 and plans.clear_stages(spark) == 0


def test_least_written_score():
    for limit in (0.5, 0.25, 0.9, 0.33):
        least = S.least_written(limit)
        assert float(f"{least:.4f}") > limit and not float(f"{math.nextafter(least, 0):.4f}") > limit


def test_union_area_is_no_more_than_the_sum(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i % 7), int(i), 0.9, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(1, 30, (200, 4)))]
    df = spark.createDataFrame(rows, "file_id long, box_no long, score double, minx double, miny double, maxx double, maxy double")
    m = boxes.parts(df, "file_id").cache()
    f = boxes.part_features(df, "file_id", geometry=True).cache()
    area = {(r.file_id, r.part): r.area for r in f.collect()}
    shapes = polygon.with_measures(f.drop("area").withColumn("rings", polygon.wkt_rings(F.col("geometry"))), "rings")
    assert {(r.file_id, r.part): r.area for r in shapes.collect()} == area  # holes too
    cover = {}
    for r in m.collect():
        cover.setdefault((r.file_id, r.part), set()).update((x, y) for x in range(int(r.minx), int(r.maxx)) for y in range(int(r.miny), int(r.maxy)))
    assert area == {k: float(len(v)) for k, v in cover.items()}
