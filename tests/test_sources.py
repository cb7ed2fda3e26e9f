import json
import struct
import zlib

import numpy as np
import pytest

from terraframe.operators import archive
from terraframe.sources import geotiff, texts, vectors
from terraframe.streaming import arriving_boxes


def pack_lzw(data):
    """TIFF LZW with plain literal codes, cleared often enough to stay at nine bits."""
    codes = []
    for i, b in enumerate(data):
        if i % 200 == 0:
            codes.append(256)
        codes.append(b)
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_lzw():
    data = bytes(range(256)) * 3
    assert geotiff.lzw(pack_lzw(data)) == data
    # a stream with growing codes: 'abababab...' coded by table entries
    table, word, codes = {bytes([i]): i for i in range(256)}, b"", [256]
    text = b"abcabcabcabcabcabc" * 200
    nxt = 258
    for i in range(len(text)):
        c = text[i:i + 1]
        if word + c in table:
            word += c
        else:
            codes.append(table[word])
            table[word + c] = nxt
            nxt += 1
            word = c
    codes += [table[word], 257]
    out, n, width, size = "", 0, 9, 258
    for c in codes:
        out += f"{c:0{width}b}"
        n += 1
        if c != 256:
            size += n > 2
            width = max(9, (size + 1).bit_length())
    assert geotiff.lzw(int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")) == text


@pytest.mark.parametrize("kind", [np.float32, np.uint8])
def test_raster_round_trip(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    a = (rng.random((150, 97, 3 if kind is np.uint8 else 1)) * 200).astype(kind)
    if kind is np.float32:
        a[3:9, 5:9] = -9999
    (tmp_path / "a.tif").write_bytes(geotiff.encode(a, 0.5, 600000.0, 700000.0, 2157, -9999.0 if kind is np.float32 else None, strip=32))
    meta = geotiff.scan_metadata(geotiff.list_rasters(spark, str(tmp_path))).collect()[0]
    assert (meta.epsg, meta.res, meta.x_min, meta.y_max, meta.width, meta.height, meta.bands) == (2157, 0.5, 600000.0, 700000.0, 97, 150, a.shape[2])
    rasters = geotiff.scan_metadata(geotiff.list_rasters(spark, str(tmp_path)))
    px = {(r.r, r.c): r.z for r in geotiff.as_pixels(geotiff.read_tiles(rasters, 64), 64).collect() if r.z is not None}
    assert px == {(r, c): float(a[r, c, 0]) for r in range(150) for c in range(97) if a[r, c, 0] != -9999}
    halo = geotiff.read_tiles(rasters, 64, 5).filter("tr = 0 and tc = 1").first()
    v = np.array(halo["values"]).reshape(halo["rows"], halo["cols"], halo["bands"])
    assert np.isnan(v[:5]).all() and v[5, 5, 0] == a[0, 64, 0] and np.isnan(v[5:, 64 + 5 - 31 + 0:, 0]).all()


def test_plain_tiled_tiff():
    a = np.arange(40 * 40, dtype="<u2").reshape(40, 40)
    tiles = [np.pad(a, ((0, 8), (0, 8)))[r:r + 16, c:c + 16].astype("<u2") for r in (0, 16, 32) for c in (0, 16, 32)]
    blocks = [zlib.compress(np.diff(t.astype(np.uint16), axis=1, prepend=np.uint16(0)).tobytes()) for t in tiles]
    tags = [(256, 4, [40]), (257, 4, [40]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, None), (325, 4, [len(b) for b in blocks])]
    at = 8 + 2 + 12 * len(tags) + 4
    offs, extra = [], at + 2 * 4 * len(blocks)
    for b in blocks:
        offs.append(extra)
        extra += len(b)
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, kind, v in tags:
        v = offs if v is None else v
        raw = struct.pack(f"<{len(v)}{'I' if kind == 4 else 'H'}", *v)
        head += struct.pack("<HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(tail)))
        tail += raw if len(raw) > 4 else b""
    import io

    f = io.BytesIO(head + b"\0" * 4 + tail + b"".join(blocks))
    h = geotiff.header(f)
    assert np.array_equal(geotiff.read_window(f, h, 0, 40, 0, 40)[..., 0], a)
    assert np.array_equal(geotiff.read_window(f, h, 10, 20, 12, 35)[..., 0], a[10:20, 12:35])
    with pytest.raises(ValueError, match="TIFF"):
        geotiff.header(io.BytesIO(b"x" * 40))


def test_tile_sink(spark, tmp_path):
    v = [float(i) for i in range(12)]
    df = spark.createDataFrame([("t1.tif", 3, 4, 1, v, 2.0, 10.0, 20.0, 2157, None)], "name string, rows int, cols int, bands int, values array<float>, res double, x_min double, y_max double, epsg int, nodata double")
    assert geotiff.write_tiles(df, str(tmp_path)).count() == 1
    with geotiff.open_file(str(tmp_path / "t1.tif")) as f:
        assert geotiff.read_window(f, geotiff.header(f), 0, 3, 0, 4).ravel().tolist() == v


def test_geopackage_round_trip(spark, tmp_path):
    rows = [(1, "a", 0.5, "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 0.5, 2.0 0.5, 2.0 1.0, 1.0 0.5))"), (2, None, None, "POINT (1.5 2.5)"), (3, "c", float("nan"), None),
            (4, "d", 1.0, "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)), ((5.0 5.0, 6.0 5.0, 6.0 6.0, 5.0 5.0)))")]
    df = spark.createDataFrame(rows, "id long, label string, score double, geometry string").coalesce(1)
    assert [r.features for r in vectors.write_gpkg(df, str(tmp_path), "found").collect()] == [4]
    back = {r.id: (r.label, r.score, r.geometry) for r in vectors.read_gpkg(spark, str(tmp_path), "found", "id long, label string, score double").collect()}
    assert back[1] == ("a", 0.5, "MULTIPOLYGON ((" + rows[0][3].removeprefix("POLYGON (") + ")")
    assert back[2] == (None, None, "POINT (1.5 2.5)") and back[3][0] == "c" and back[3][2] is None and back[4][2] == rows[3][3]
    lines = [json.loads(r.value) for r in vectors.geojson_lines(df).collect()]
    assert [x["geometry"] and x["geometry"]["type"] for x in lines] == ["Polygon", "Point", None, "MultiPolygon"]
    assert len(lines[0]["geometry"]["coordinates"]) == 2 and lines[3]["properties"] == {"id": 4, "label": "d", "score": 1.0}


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([("a/x.txt", "1 2 3 4 AO 0.5 2157 0.5 6 7\n"), ("b.txt", ""), ("c.txt", None)], "name string, text string")
    assert texts.write_texts(df, str(tmp_path)).count() == 3
    back = texts.small_files(spark, str(tmp_path))
    assert sorted(r.content for r in back.collect()) == ["1 2 3 4 AO 0.5 2157 0.5 6 7\n"]
    assert archive.box_lines(back).count() == 1
    q = arriving_boxes(spark, str(tmp_path)).writeStream.format("memory").queryName("boxes").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("boxes").count() == 1
    b = spark.createDataFrame([(2.5, 3.5, 4.4, 5.6, 2, 0.25)], "x0 double, y0 double, x1 double, y1 double, k int, score double")
    assert texts.legacy_box_text(b.withColumn("label", texts.legacy_label(b.k))).first().line == "2 4 4 6 barrow 0.25"


def test_features_straight_from_files(spark, tmp_path):
    from terraframe.plans import pipeline

    rng = np.random.default_rng(2)
    z = np.round(rng.random((90, 75)) * 2, 2).astype(np.float32)
    z[20:30, 10:40] = -9999
    (tmp_path / "z.tif").write_bytes(geotiff.encode(z, 1.0, 0.0, 0.0, 2157, -9999.0))
    rasters = geotiff.scan_metadata(geotiff.list_rasters(spark, str(tmp_path)))
    p = pipeline.RunParameters(ml_type="segmentation", labels=("AO", "barrow"), roundness=0.2, min_area=3.0)
    cols = ("label", "n_pix", "area", "c0", "r0", "c1", "r1")
    px = [(r, c, None if z[r, c] == -9999 else float(z[r, c])) for r in range(90) for c in range(75)]
    a = pipeline.segmentation(spark.createDataFrame(px, "r long, c long, z double"), p, 1.0, 75, 32)
    b = pipeline.segmentation_of_files(rasters, p, 1.0, 32)
    one, two = (sorted((*r[:-1], round(r[-1], 6)) for r in f.select(*cols, "roundness").collect()) for f in (a, b))
    assert one and one == two
