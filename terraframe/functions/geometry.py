"""Extents of (E)WKT text and box arithmetic, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PAIR = rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*"
BOUNDS = ("minx", "miny", "maxx", "maxy")


def wkt_extent(geometry: Column) -> Column:
    """Bounding box of a WKT or EWKT text as struct(minx, miny, maxx, maxy).

    Any geometry type, Z/M ordinates, exponents, letter case and blanks are
    accepted. Null, EMPTY and texts without a coordinate give null bounds.
    """
    xs = F.transform(F.regexp_extract_all(geometry, F.lit(_PAIR), F.lit(1)), lambda v: v.cast("double"))
    ys = F.transform(F.regexp_extract_all(geometry, F.lit(_PAIR), F.lit(2)), lambda v: v.cast("double"))
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


def with_extent(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Add minx, miny, maxx, maxy of a WKT column; rows are kept, bounds may be null.

    Columns of these names that the input already has are replaced.
    """
    out = df.withColumn("__e", wkt_extent(F.col(geometry)))
    for b in BOUNDS:
        out = out.withColumn(b, F.col(f"__e.{b}"))
    return out.drop("__e")


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Length shared by two intervals, 0 if they are apart."""
    return F.greatest(F.lit(0.0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def to_world(x_min: Column, y_max: Column, res: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """Pixel position (from the top left) to ground coordinates."""
    return x_min + res * px, y_max - res * py
