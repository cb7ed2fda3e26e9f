"""GeoTIFF rasters: header scan, windowed reads by byte range, tile sink. Pure Python and NumPy.

Reads classic and big TIFF, strips or tiles, uncompressed, deflate or LZW, with
predictors 1 to 3. Writes deflate with a predictor.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.plans import tasks

# fixed values: TIFF field types (letter of struct, bytes) and tag numbers
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT, SCALE, TIEPOINT, GEOKEYS, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
EPSG_KEYS = (3072, 2048)

META = "path string, epsg int, res double, x_min double, y_max double, width int, height int, bands int, nodata double"


class Header(NamedTuple):
    order: str
    tags: dict


def open_file(path: str):
    """A seekable file on any filesystem pyarrow knows."""
    from pyarrow import fs

    path = path.removeprefix("file:") if path.startswith("file:") else path
    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(at)


def header(f) -> Header:
    """Tags of the first image; reads the directory and its values only."""
    f.seek(0)
    lead = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(lead[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", lead[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), lead[8:16] if big else lead[4:8])[0]
    head, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    f.seek(at)
    n = struct.unpack(order + head, f.read(struct.calcsize(head)))[0]
    body, tags = f.read(n * entry), {}
    for k in range(n):
        e = body[k * entry:(k + 1) * entry]
        tag, kind = struct.unpack(order + "HH", e[:4])
        count = struct.unpack(order + ("Q" if big else "I"), e[4:4 + inline])[0]
        letter, size = TYPES.get(kind, ("B", 1))
        raw = e[4 + inline:]
        if count * size > inline:
            f.seek(struct.unpack(order + ("Q" if big else "I"), raw[:inline])[0])
            raw = f.read(count * size)
        raw = raw[:count * size]
        tags[tag] = raw.rstrip(b"\0").decode("latin-1") if letter == "s" else struct.unpack(order + letter * count, raw)
    return Header(order, tags)


def metadata(path: str, h: Header) -> tuple:
    t = h.tags
    if SCALE in t and abs(t[SCALE][0] - t[SCALE][1]) > 1e-9 * abs(t[SCALE][0]):
        raise ValueError(f"{path}: pixels are not square")
    keys = t.get(GEOKEYS, ())
    epsg = next((keys[k + 3] for want in EPSG_KEYS for k in range(4, len(keys), 4) if keys[k] == want and keys[k + 1] == 0), None)
    tie = t.get(TIEPOINT, (0.0,) * 6)
    res = t[SCALE][0] if SCALE in t else 1.0
    nodata = t.get(NODATA)
    try:
        nodata = None if nodata is None else float(nodata)
    except ValueError:
        nodata = None
    return path, epsg, res, tie[3] - tie[0] * res, tie[4] + tie[1] * res, t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0], nodata


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, 256 clears, 257 ends."""
    out, table, width, last, bits, have = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b"", 0, 0
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        while have >= width:
            have -= width
            code, bits = bits >> have, bits & ((1 << have) - 1)
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last:
                table.append(last + word[:1])
            last = word
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


_inflated = lru_cache(maxsize=8)(zlib.decompress)  # for blocks of few bytes, which recur where a raster is blank; such hold a megabyte at most


def _block(raw: bytes, h: Header, rows: int, cols: int, samples: int) -> np.ndarray:
    t = h.tags
    how = t.get(COMPRESSION, (1,))[0]
    if how == 5:
        raw = lzw(raw)
    elif how in (8, 32946):
        raw = _inflated(raw) if len(raw) < 1024 else zlib.decompress(raw)
    elif how != 1:
        raise ValueError(f"compression {how} is not supported")
    size = t.get(BITS, (8,))[0] // 8
    kind = np.dtype(f"{ {1: 'u', 2: 'i', 3: 'f'}[t.get(FORMAT, (1,))[0]] }{size}")
    predictor = t.get(PREDICTOR, (1,))[0]
    if predictor == 3:  # bytes of each row by significance, differences along the row
        b = np.frombuffer(raw, np.uint8)[: rows * cols * samples * size].reshape(rows, -1)
        b = np.add.accumulate(b.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols, samples).astype(kind)
    a = np.frombuffer(raw, kind.newbyteorder(h.order))[: rows * cols * samples].reshape(rows, cols, samples).astype(kind)
    if predictor == 2:
        on = (a != 0).reshape(rows, -1).any(1)  # a row without differences is all 0
        a[on] = np.add.accumulate(a[on], axis=1, dtype=kind)
    return a


class Layout(NamedTuple):
    """Size of a raster and of its stored blocks, and how many of them lie across and down, in each plane."""

    width: int
    height: int
    bands: int
    tiled: bool
    bw: int
    bh: int
    across: int
    down: int
    planes: int


def layout(h: Header) -> Layout:
    t = h.tags
    width, height, bands = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
    tiled = TILE_WIDTH in t
    bw, bh = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(STRIP_ROWS, (height,))[0], height))
    return Layout(width, height, bands, tiled, bw, bh, -(-width // bw), -(-height // bh), bands if t.get(PLANAR, (1,))[0] == 2 else 1)


def _stored(f, h: Header, g: Layout, by: int, bx: int) -> np.ndarray:
    """One stored block, (rows, cols, bands) in its own kind of number, cut where the raster ends."""
    at, sizes = (h.tags[TILE_AT], h.tags[TILE_BYTES]) if g.tiled else (h.tags[STRIP_AT], h.tags[STRIP_BYTES])
    rows = g.bh if g.tiled else min(g.bh, g.height - by * g.bh)
    parts = []
    for p in range(g.planes):
        k = p * g.across * g.down + by * g.across + bx
        f.seek(at[k])
        parts.append(_block(f.read(sizes[k]), h, rows, g.bw, g.bands // g.planes))
    a = parts[0] if g.planes == 1 else np.concatenate(parts, axis=2)
    return a[:g.height - by * g.bh, :g.width - bx * g.bw]


def blocks(f, h: Header) -> Iterator[np.ndarray]:
    """The raster's stored blocks one after the other; together they hold every pixel once."""
    g = layout(h)
    for by in range(g.down):
        for bx in range(g.across):
            yield _stored(f, h, g, by, bx)


def read_window(f, h: Header, row0: int, row1: int, col0: int, col1: int) -> np.ndarray:
    """Pixels [row0, row1) x [col0, col1) as (rows, cols, bands) of float; outside the raster NaN. Only blocks that meet the window are read."""
    g = layout(h)
    bw, bh = g.bw, g.bh
    out = np.full((row1 - row0, col1 - col0, g.bands), np.nan)
    for by in range(max(row0, 0) // bh, min(-(-row1 // bh), g.down)):
        for bx in range(max(col0, 0) // bw, min(-(-col1 // bw), g.across)):
            a = _stored(f, h, g, by, bx)
            r0, r1 = max(row0, by * bh), min(row1, by * bh + a.shape[0])
            c0, c1 = max(col0, bx * bw), min(col1, bx * bw + a.shape[1])
            if r0 < r1 and c0 < c1:
                out[r0 - row0:r1 - row0, c0 - col0:c1 - col0] = a[r0 - by * bh:r1 - by * bh, c0 - bx * bw:c1 - bx * bw]
    return out


def list_rasters(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """Paths of the raster files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")


def scan_metadata(paths: DataFrame) -> DataFrame:
    """path, epsg, res, x_min, y_max, width, height, bands and nodata of each file, from its header alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["path"]:
                with open_file(p) as f:
                    out.append(metadata(p, header(f)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in META.split(", ")]).astype({"epsg": "Int32", "nodata": "Float64"})

    return paths.select("path").mapInPandas(run, META)


def read_tiles(rasters: DataFrame, tile: int, halo: int = 0) -> DataFrame:
    """Tiles of each raster (path, width, height): path, tr, tc, rows, cols, bands, values, with a halo on each side, and epsg, res, x_min, y_max of the tile without it.

    Each tile is one row and one ranged read, so a giant raster is read by many
    tasks. Places outside the raster and nodata are NaN.
    """
    n = lambda c: F.explode(F.sequence(F.lit(0), F.ceil(F.col(c) / tile).cast("int") - 1))
    w = rasters.filter("width > 0 and height > 0").select("path", n("height").alias("tr"), "width").select("path", "tr", n("width").alias("tc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, g in b.groupby("path"):
                with open_file(path) as f:
                    h = header(f)
                    _, epsg, res, x_min, y_max, *_, nodata = metadata(path, h)
                    for tr, tc in zip(g["tr"], g["tc"], strict=True):
                        a = read_window(f, h, tr * tile - halo, (tr + 1) * tile + halo, tc * tile - halo, (tc + 1) * tile + halo)
                        if nodata is not None:
                            a = np.where(a == nodata, np.nan, a)
                        yield pd.DataFrame({"path": [path], "tr": [tr], "tc": [tc], "rows": [a.shape[0]], "cols": [a.shape[1]], "bands": [a.shape[2]], "values": [a.astype(np.float32).ravel()],
                                            "epsg": pd.array([epsg], "Int32"), "res": [res], "x_min": [x_min + tc * tile * res], "y_max": [y_max - tr * tile * res]})

    return w.repartition(tasks(w), "path", "tr", "tc").mapInPandas(run, "path string, tr int, tc int, rows int, cols int, bands int, values array<float>, epsg int, res double, x_min double, y_max double")


def as_pixels(tiles: DataFrame, tile: int, band: int = 0) -> DataFrame:
    """Pixel rows (path, r, c, z) of tiles without halo; nodata is null."""
    p = tiles.select("path", "tr", "tc", "cols", "bands", F.posexplode("values").alias("i", "v")).filter(F.col("i") % F.col("bands") == band)
    i = F.floor(F.col("i") / F.col("bands"))
    return p.select("path", (F.col("tr") * tile + F.floor(i / F.col("cols"))).cast("long").alias("r"), (F.col("tc") * tile + i % F.col("cols")).cast("long").alias("c"), F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double")).alias("z"))


def _runs_packed(data: bytes) -> bytes:
    """Deflate that looks for runs alone: for masks faster than the usual search, and no larger."""
    c = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_RLE)
    return c.compress(data) + c.flush()


@lru_cache(maxsize=8)
def _blank_packed(n: int) -> bytes:
    return _runs_packed(bytes(n))


def encode(a: np.ndarray, res: float, x_min: float, y_max: float, epsg: int | None = None, nodata: float | None = None, strip: int = 64) -> bytes:
    """A georeferenced TIFF of (rows, cols[, bands]), float32 or uint8 (taken for a mask), deflate with predictor 3 or 2."""
    a = a[..., None] if a.ndim == 2 else a
    rows, cols, bands = a.shape
    flt = a.dtype.kind == "f"
    a = a.astype("<f4" if flt else np.uint8)
    chunks = []
    for k in range(0, rows, strip):
        p = a[k:k + strip]
        if not flt and not p.any():
            chunks.append(_blank_packed(p.size))
            continue
        if flt:
            b = p.astype(">f4").reshape(len(p), cols * bands, 1).view(np.uint8).transpose(0, 2, 1).reshape(len(p), -1, bands)
        else:
            b = p
        d = b.copy()
        d[:, 1:] = b[:, 1:] - b[:, :-1]
        chunks.append((zlib.compress if flt else _runs_packed)(np.ascontiguousarray(d).tobytes()))
    entries = [
        (WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [32 if flt else 8] * bands), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [1]), (STRIP_AT, "I", [0] * len(chunks)), (SAMPLES, "H", [bands]), (STRIP_ROWS, "I", [strip]),
        (STRIP_BYTES, "I", [len(c) for c in chunks]), (PLANAR, "H", [1]), (PREDICTOR, "H", [3 if flt else 2]), (FORMAT, "H", [3 if flt else 1] * bands), (SCALE, "d", [res, res, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, x_min, y_max, 0.0])]
    if epsg:
        entries.append((GEOKEYS, "H", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]))
    if nodata is not None:
        entries.append((NODATA, "s", [repr(float(nodata)).encode() + b"\0"]))
    kind = {"H": 3, "I": 4, "d": 12, "s": 2}
    extra_at = 8 + 2 + 12 * len(entries) + 4
    size = sum(s for s in (len(v[0]) if t == "s" else struct.calcsize(t) * len(v) for _, t, v in entries) if s > 4)
    at = extra_at + size
    offsets = []
    for c in chunks:
        offsets.append(at)
        at += len(c)
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag, t, v in entries:
        v = offsets if tag == STRIP_AT else v
        raw = v[0] if t == "s" else struct.pack(f"<{len(v)}{t}", *v)
        count = len(raw) if t == "s" else len(v)
        head += struct.pack("<HHI", tag, kind[t], count)
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack("<I", extra_at + len(extra))
            extra += raw
    return head + struct.pack("<I", 0) + extra + b"".join(chunks)


def made_folder(folder: str) -> tuple:
    """Filesystem and path in it of a folder, which is made where it is missing."""
    from pyarrow import fs

    plain = folder.removeprefix("file:") if folder.startswith("file:") else folder
    where, base = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
    where.create_dir(base, recursive=True)
    return where, base


def write_tiles(tiles: DataFrame, folder: str) -> DataFrame:
    """Write tiles (name, rows, cols, bands, values, res, x_min, y_max, epsg, nodata) as files; gives path, name and n_bytes of each.

    values is an array of numbers (stored as 32-bit floats) or binary (stored as
    bytes). Runs when the result is read. Names should be unique; a rerun of a
    task writes the same file again.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = made_folder(folder)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                a = np.frombuffer(r.values, np.uint8) if isinstance(r.values, bytes | bytearray) else np.asarray(r.values, np.float32)
                data = encode(a.reshape(r.rows, r.cols, r.bands), r.res, r.x_min, r.y_max, None if pd.isna(r.epsg) else int(r.epsg), None if pd.isna(r.nodata) else float(r.nodata))
                if "/" in r.name:
                    where.create_dir(f"{base}/{r.name}".rpartition("/")[0], recursive=True)
                with where.open_output_stream(f"{base}/{r.name}") as f:
                    f.write(data)
                out.append((f"{folder}/{r.name}", r.name, len(data)))
            yield pd.DataFrame(out, columns=["path", "name", "n_bytes"])

    need = ("name", "rows", "cols", "bands", "values", "res", "x_min", "y_max", "epsg", "nodata")
    return tiles.select(*need).mapInPandas(run, "path string, name string, n_bytes long")
