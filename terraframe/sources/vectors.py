"""Vector files: GeoPackage in and out, GeoJSON lines out."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.operators.polygon import rings


def wkb(wkt: str | None) -> bytes | None:
    """Little-endian WKB of a polygon or multipolygon text (as a multipolygon), or of a point."""
    if not wkt or "(" not in wkt:
        return None
    if wkt.split("(")[0].strip().upper().split(";")[-1].split(" ")[0] == "POINT":
        x, y = (float(v) for v in wkt[wkt.index("(") + 1:].strip(" )").split()[:2])
        return struct.pack("<BIdd", 1, 1, x, y)
    body = wkt[wkt.index("("):]
    polys: list[list[np.ndarray]] = []
    depth = 0
    multi = wkt.upper().split(";")[-1].lstrip().startswith("MULTI")
    for piece in body.replace("(", " ( ").replace(")", " ) ").split(" ( ")[1:]:
        if "," in piece or any(ch.isdigit() for ch in piece):
            r = rings("(" + piece.split(")")[0] + ")")
            if r:
                if depth or not polys:
                    polys.append([])
                polys[-1].append(r[0])
            depth = 0
        elif multi or not polys:
            depth += 1
    out = struct.pack("<BII", 1, 6, len(polys))
    for p in polys:
        out += struct.pack("<BII", 1, 3, len(p))
        for r in p:
            out += struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes()
    return out


def wkt(blob: bytes | None) -> str | None:
    """Text of a WKB or GeoPackage geometry: points, polygons and multipolygons, 2D or Z."""
    if blob is None:
        return None
    at = 0
    if blob[:2] == b"GP":
        at = 8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]

    def geom(at: int) -> tuple[str, str, int]:
        e = "<" if blob[at] else ">"
        kind = struct.unpack_from(e + "I", blob, at + 1)[0]
        dims = 3 if kind & 0x80000000 or (kind % 10000) // 1000 == 1 else 2
        kind = (kind & 0xFFFF) % 1000
        at += 5

        def points(n: int, at: int) -> tuple[str, int]:
            v = np.frombuffer(blob, e + "f8", n * dims, at).reshape(n, dims)
            return ", ".join(f"{float(x)!r} {float(y)!r}" for x, y in v[:, :2]), at + n * dims * 8

        if kind == 1:
            s, at = points(1, at)
            return "POINT", f"({s})", at
        n = struct.unpack_from(e + "I", blob, at)[0]
        at += 4
        parts = []
        for _ in range(n):
            if kind == 3:
                k = struct.unpack_from(e + "I", blob, at)[0]
                s, at = points(k, at + 4)
                parts.append(f"({s})")
            elif kind == 6:
                _, s, at = geom(at)
                parts.append(s)
            else:
                raise ValueError(f"geometry type {kind} is not supported")
        return {3: "POLYGON", 6: "MULTIPOLYGON"}[kind], f"({', '.join(parts)})" if parts else "EMPTY", at

    name, body, _ = geom(at)
    return f"{name} {body}"


def write_gpkg(df: DataFrame, folder: str, layer: str, geometry: str = "geometry", epsg: int = 2157) -> DataFrame:
    """One GeoPackage per partition in `folder` (file names `<layer>-<n>.gpkg`); gives name and number of features.

    Runs when the result is read. For a single file coalesce the features first:
    they are few against the pixels. Columns may be of any simple type.
    """
    names = [c for c in df.columns if c != geometry]
    kinds = {"double": "REAL", "float": "REAL", "string": "TEXT"}
    cols = ", ".join(f'"{c}" {kinds.get(t, "INTEGER")}' for c, t in df.dtypes if c != geometry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        n = part = None
        db = sqlite3.connect(":memory:")  # no scratch file on the machine
        db.executescript(f"""pragma application_id = 1196444487; pragma user_version = 10300;
create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text, description text);
create table gpkg_contents (table_name text primary key, data_type text, identifier text, description text, last_change text default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer);
create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint);
insert into gpkg_spatial_ref_sys values ('EPSG:{epsg}', {epsg}, 'EPSG', {epsg}, 'undefined', null);
insert into gpkg_contents (table_name, data_type, identifier, srs_id) values ('{layer}', 'features', '{layer}', {epsg});
insert into gpkg_geometry_columns values ('{layer}', 'geom', 'GEOMETRY', {epsg}, 0, 0);
create table "{layer}" (fid integer primary key autoincrement, geom blob{', ' + cols if cols else ''});""")
        for b in batches:
            lead = struct.pack("<2sBBi", b"GP", 0, 1, epsg)
            geo = [None if (w := wkb(g)) is None else lead + w for g in b[geometry]]
            rows = [[None if v is None or v != v else (v.item() if hasattr(v, "item") else v) for v in r] for r in b[names].itertuples(index=False)]
            db.executemany(f'insert into "{layer}" (geom{"".join(f", {chr(34)}{c}{chr(34)}" for c in names)}) values ({", ".join("?" * (len(names) + 1))})', [[g, *r] for g, r in zip(geo, rows, strict=True)])
            n = (n or 0) + len(b)
        db.commit()
        if n is not None:
            from pyspark import TaskContext

            part = f"{layer}-{TaskContext.get().partitionId():05d}.gpkg"
            plain = folder.removeprefix("file:") if folder.startswith("file:") else folder
            where, base = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
            where.create_dir(base, recursive=True)
            with where.open_output_stream(f"{base}/{part}") as f:
                f.write(db.serialize())
        if n is not None:
            yield pd.DataFrame({"name": [part], "features": [n]})

    return df.mapInPandas(run, "name string, features long")


def read_gpkg(spark: SparkSession, folder: str, layer: str, schema: str) -> DataFrame:
    """Features of a layer in all GeoPackages under a folder, one task per file: `schema` columns and `geometry` as text."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for body in b["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(body)
                geo = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", [layer]).fetchone()[0]
                cur = db.execute(f'select "{geo}", {", ".join(chr(34) + c + chr(34) for c in names)} from "{layer}"')
                while rows := cur.fetchmany(10_000):
                    p = pd.DataFrame(rows, columns=["geometry", *names])
                    yield p.assign(geometry=[wkt(g) for g in p["geometry"]])
                db.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(folder)
    return files.select("content").mapInPandas(run, f"geometry string, {schema}")


def geojson_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Features as GeoJSON, one text row each (`value`), for `write.text`."""
    names = [c for c in df.columns if c != geometry]

    def geo(text: str | None) -> dict | None:
        blob = wkb(text)
        if blob is None:
            return None
        if struct.unpack_from("<I", blob, 1)[0] == 1:
            return {"type": "Point", "coordinates": list(struct.unpack_from("<dd", blob, 5))}
        polys, at = [], 9
        for _ in range(struct.unpack_from("<I", blob, 5)[0]):
            n, at, poly = struct.unpack_from("<I", blob, at + 5)[0], at + 9, []
            for _ in range(n):
                k = struct.unpack_from("<I", blob, at)[0]
                poly.append(np.frombuffer(blob, "<f8", 2 * k, at + 4).reshape(k, 2).tolist())
                at += 4 + 16 * k
            polys.append(poly)
        return {"type": "Polygon", "coordinates": polys[0]} if len(polys) == 1 else {"type": "MultiPolygon", "coordinates": polys}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": [json.dumps({"type": "Feature", "geometry": geo(g), "properties": json.loads(p)}, ensure_ascii=False) for g, p in zip(b[geometry], b["__p"], strict=True)]})

    return df.select(geometry, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("__p") if names else F.lit("{}").alias("__p")).mapInPandas(run, "value string")
