"""Scalar and projection layer: rounding, clamping, names and log units as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("AO", "barrow", "ringfort", "enclosure")  # fixed values: classes of the detectors


def half_even(x: Column) -> Column:
    """Nearest integer, ties to the even one (pixel coordinates of boxes)."""
    return F.bround(x).cast("long")


def truncated(x: Column) -> Column:
    """Integer part, towards zero."""
    return x.cast("long")


def snap_down(x: Column, step: Column) -> Column:
    return F.floor(x / step) * step


def snap_up(x: Column, step: Column) -> Column:
    return F.ceil(x / step) * step


def as_value(z: Column, nodata: Column | None = None) -> Column:
    """Pixel value, null where it is NaN, null or equal to nodata (which may be null or NaN itself)."""
    v = F.nanvl(z.cast("double"), F.lit(None).cast("double"))
    return v if nodata is None else F.when(v.eqNullSafe(F.nanvl(nodata.cast("double"), F.lit(None).cast("double"))), F.lit(None).cast("double")).otherwise(v)


def unit_clamped(z: Column, nodata: Column | None = None) -> Column:
    """Value held to [0, 1]; nodata becomes 0 (training images)."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(as_value(z, nodata), F.lit(0.0))))


def stretched(z: Column, low: float = -0.5, high: float = 0.5) -> Column:
    """Linear stretch of [low, high] to [0, 1], clamped; null and NaN become 0."""
    v = as_value(z)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.lit(low)) / F.lit(high - low))), F.lit(0.0))


def relief_radius(res: Column) -> Column:
    """Radius in pixels of the local mean: 10 m, at least 10 pixels."""
    return F.when(res < 1, F.ceil(F.lit(10.0) / res)).otherwise(F.lit(10)).cast("int")


def roundness(area: Column, hull_perimeter: Column) -> Column:
    """1 for a circle, pi/4 for a square; null where the hull has no length."""
    return F.try_divide(F.lit(4 * math.pi) * area, hull_perimeter * hull_perimeter)


def rounded(x: Column, digits: int) -> Column:
    """x to some decimals as C and Python print it: to nearest by its binary value, exact ties to even.

    The error of x * 10^digits is found exactly (by splitting x in two halves),
    so a product that only rounds to a tie goes the right way.
    """
    s = F.lit(float(10**digits))
    t = x * F.lit(134217729.0)
    hi = t - (t - x)
    y = x * s
    err = (hi * s - y) + (x - hi) * s
    tie = (y - F.floor(y)) == F.lit(0.5)
    n = F.when(tie & (err > 0), F.floor(y) + 1).when(tie & (err < 0), F.floor(y)).otherwise(F.rint(y))
    return n / s


def printed(x: Column, digits: int, unit: str = "") -> Column:
    """Text of x with fixed decimals; null stays null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f{unit}", rounded(x.cast("double"), digits)))


def score_text(score: Column) -> Column:
    """Score as it is written to box files, four decimals."""
    return printed(score, 4)


def least_written(limit: float, digits: int = 4) -> float:
    """The smallest number whose text with some decimals reads above the limit."""
    lo, hi = limit - 10.0**-digits, limit + 2 * 10.0**-digits
    while math.nextafter(lo, hi) < hi:
        mid = (lo + hi) / 2
        if float(f"{mid:.{digits}f}") > limit:
            hi = mid
        else:
            lo = mid
    return hi


def is_confident(score: Column, least: float = 0.5) -> Column:
    """Strictly above the limit, judged on the written four decimals; NaN and null are not.

    A plain comparison with the least such number, so it reaches the scan.
    """
    return F.coalesce((score >= F.lit(least_written(least))) & ~F.isnan(score), F.lit(False))


def path_tail(path: Column, parts: int = 3) -> Column:
    """The last parts of a path, joined by slashes (all, if it has fewer)."""
    p = F.split(path, "/")
    return F.array_join(F.slice(p, F.greatest(F.size(p) - F.lit(parts), F.lit(0)) + 1, F.lit(parts)), "/")


def stem(path: Column) -> Column:
    """File name without its folder and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def before_first_dot(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def filestem(minx: Column, miny: Column) -> Column:
    """Patch name from its lower left corner, truncated."""
    return F.concat_ws("_", truncated(minx).cast("string"), truncated(miny).cast("string"))


def patch_path(stem_: Column, raster: Column, kind: str, ext: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), stem_, F.lit("__"), raster, F.lit(f"__{kind}.{ext}"))


def relief_tile_name(left: Column, bottom: Column) -> Column:
    return F.format_string("%d_%d_rvt.tif", half_even(left), half_even(bottom))


def clip_tile_name(number: Column, stem_: Column) -> Column:
    return F.format_string("tile_%06d_%s.tif", number.cast("long"), stem_)


def run_folder(stem_: Column, at: Column, ml_type: Column) -> Column:
    """Result folder: name, time of start and _obj for object detection, else _seg."""
    return F.concat(stem_, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.when(ml_type == "object detection", "_obj").otherwise("_seg"))


def label_name(title: Column, checked: Column) -> Column:
    """Label of a checked box: lower case, all archaeology is AO; null if unchecked."""
    low = F.lower(title)
    return F.when(checked, F.when(low == "all archaeology", "AO").otherwise(low))


def capitalised(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def duration_text(seconds: Column) -> Column:
    """Seconds below a minute, else minutes, one decimal."""
    return F.when(seconds >= 60, printed(seconds / 60, 1, " min")).otherwise(printed(seconds, 1, " sec"))


def size_text(n_bytes: Column) -> Column:
    """kB, MB or GB (powers of 1024), two decimals."""
    k = F.lit(1024.0)
    return F.when(n_bytes >= 1024**3, printed(n_bytes / k / k / k, 2, " GB")).when(
        n_bytes >= 1024**2, printed(n_bytes / k / k, 2, " MB")).otherwise(printed(n_bytes / k, 2, " kB"))
