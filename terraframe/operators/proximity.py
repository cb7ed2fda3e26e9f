"""Points near other points, and regions that hold points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.plans import stage

EARTH_RADIUS_M = 6371008.8
HOT_CELL = 4000  # rows of one cell that one task should meet at most


def _spread(points: DataFrame, probes: DataFrame, cell: list[str], hot: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Give crowded cells several salts: a point gets one of them, a probe is copied to all.

    Counts are pre-aggregated on the map side; only crowded cells (at most
    rows/hot of them) are joined back, the engine broadcasts them if small.
    """
    crowd = (
        points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
        .select(*cell, F.ceil(F.col("n") / F.lit(hot)).cast("int").alias("salts"))
    )
    crowd = stage(crowd, "crowd")  # its true size decides how it is joined
    salted = points.join(crowd, cell, "left").withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("salts")
    copied = (
        probes.join(crowd, cell, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    )
    return salted, copied, [*cell, "salt"]


def near_pairs(df: DataFrame, id_col: str, x: str | Column, y: str | Column, radius: float,
               metric: str = "planar", hot_cell: int = HOT_CELL) -> DataFrame:
    """All pairs of different ids at most `radius` apart, as (id_a, id_b), id_a < id_b, each once.

    Points are hashed to cells as wide as the radius; each point looks into its
    own cell and half of the neighbours, so a pair is met once; the exact
    distance decides. metric "planar": x and y in the unit of radius;
    "great_circle": x is longitude and y latitude in degrees, radius in metres;
    the cells then are cubes in space, so poles and the date line need no care.

    Rows with a null or NaN id or coordinate take no part. Rows of one id count
    once per location; an id is never paired with itself. Equal locations pair
    (distance 0). An empty input gives no rows. Other columns are ignored.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    pts = df.select(F.col(id_col).alias("id"), (F.col(x) if isinstance(x, str) else x).cast("double").alias("x"),
                    (F.col(y) if isinstance(y, str) else y).cast("double").alias("y"))
    pts = pts.filter("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").distinct()
    if metric == "planar":
        axes, reach = ["x", "y"], radius
        steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    elif metric == "great_circle":
        lon, lat, r = F.radians("x"), F.radians("y"), F.lit(EARTH_RADIUS_M)
        pts = pts.select("id", "x", "y", (r * F.cos(lat) * F.cos(lon)).alias("u"), (r * F.cos(lat) * F.sin(lon)).alias("v"),
                         (r * F.sin(lat)).alias("w"))
        axes = ["u", "v", "w"]
        reach = 2 * EARTH_RADIUS_M * math.sin(min(radius / (2 * EARTH_RADIUS_M), math.pi / 2))
        steps = [s for s in ((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)) if s >= (0, 0, 0)]
    else:
        raise ValueError(f"unknown metric {metric!r}")
    width = max(reach, 1e-9) * (1 + 1e-9)
    cell = [f"c{i}" for i in range(len(axes))]
    pts = pts.select("*", *[F.floor(F.col(a) / F.lit(width)).alias(c) for a, c in zip(axes, cell, strict=True)])
    probes = pts.withColumn("s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, cell, strict=True)]) for s in steps])))
    probes = probes.select(
        F.col("id").alias("qid"), *[F.col(a).alias(f"q{a}") for a in dict.fromkeys(["x", "y", *axes])],
        F.expr(" and ".join(f"s.{c} = 0" for c in cell)).alias("own"), *[(F.col(c) + F.col(f"s.{c}")).alias(c) for c in cell])
    salted, copied, key = _spread(pts, probes, cell, hot_cell)
    if metric == "planar":
        close = F.expr(f"(x - qx) * (x - qx) + (y - qy) * (y - qy) <= {float(radius)!r}D * {float(radius)!r}D")
    else:
        h = (F.pow(F.sin((F.radians("y") - F.radians("qy")) / 2), 2)
             + F.cos(F.radians("y")) * F.cos(F.radians("qy")) * F.pow(F.sin((F.radians("x") - F.radians("qx")) / 2), 2))
        close = F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) <= F.lit(float(radius))
    met = salted.join(copied, key).filter(close & F.expr("id <> qid and (not own or qid < id)"))
    pairs = met.select(F.least("id", "qid").alias("id_a"), F.greatest("id", "qid").alias("id_b"))
    return pairs.distinct()


def points_in_regions(points: DataFrame, point_id: str, x: str, y: str, regions: DataFrame, region_id: str,
                      ring: str | None = None, hot_cell: int = HOT_CELL) -> DataFrame:
    """(point_id, region_id) for each region that holds a point, bounds included, each pair once.

    `regions` has minx, miny, maxx, maxy. Each region is hashed to the cells of
    the power-of-two grid that fits its size (four at most); points look into
    one cell of each grid in use (a few dozen at most, whatever the data). With
    `ring`, a column array<struct<x,y>>, a point must also be inside that ring
    (even-odd; on its border, a point may fall on either side).

    Null or NaN ids, coordinates or bounds take no part; repeated rows count
    once; empty inputs give no rows; other columns are ignored.
    """
    p = points.select(F.col(point_id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.filter("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").distinct()
    b = ["minx", "miny", "maxx", "maxy"]
    r = regions.select(F.col(region_id).alias("rid"), *[F.col(c).cast("double").alias(c) for c in b], *([F.col(ring).alias("ring")] if ring else []))
    r = r.filter("rid is not null and minx <= maxx and miny <= maxy and not isnan(maxx) and not isnan(maxy)").distinct()
    r = r.withColumn("lv", F.ceil(F.log2(F.greatest(F.expr("maxx - minx"), F.expr("maxy - miny"), F.lit(1e-3)))).cast("int"))
    levels = sorted(v.lv for v in r.select("lv").distinct().collect())  # at most one per power of two
    size = F.pow(F.lit(2.0), F.col("lv"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    r = r.withColumn("cx", span("minx", "maxx")).withColumn("cy", span("miny", "maxy"))
    p = p.withColumn("lv", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    p = p.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    salted, copied, key = _spread(p, r, ["lv", "cx", "cy"], hot_cell)
    held = salted.join(copied, key).filter("x >= minx and x <= maxx and y >= miny and y <= maxy")
    if ring:
        held = held.filter(_even_odd(F.col("ring"), F.col("x"), F.col("y")))
    return held.select(F.col("id").alias(point_id), F.col("rid").alias(region_id)).distinct()


def _even_odd(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) crosses the ring an odd number of times."""
    n = F.size(ring)
    crosses = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(
        (F.element_at(ring, i)["y"] > y) != (F.element_at(ring, F.pmod(i, n) + 1)["y"] > y),
        (x < F.element_at(ring, i)["x"] + (y - F.element_at(ring, i)["y"])
         / (F.element_at(ring, F.pmod(i, n) + 1)["y"] - F.element_at(ring, i)["y"])
         * (F.element_at(ring, F.pmod(i, n) + 1)["x"] - F.element_at(ring, i)["x"])).cast("int")).otherwise(0))
    return (n >= 3) & (F.pmod(F.aggregate(crosses, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))), F.lit(2)) == 1)
