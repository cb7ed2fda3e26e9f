"""Rectangle joins: bucketed equi-joins with an exact predicate, and semi joins on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.plans import stage

BOUNDS = ("minx", "miny", "maxx", "maxy")


WIDE = 4  # cells; a larger box goes to a coarser grid


def _classes(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("__own").distinct().collect())  # one per power of eight in use


def _buckets(df: DataFrame, cell: float, others: list[int]) -> DataFrame:
    """Each box in the cells it touches, at most WIDE + 1 along a side: of the grid of its own size, and of the coarser grids that hold boxes of the other side."""
    coarser = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("__own"))
    df = df.withColumn("__k", F.explode(F.array_append(coarser, F.col("__own"))) if others and others != [0] else F.col("__own"))
    df = df.withColumn("__size", F.lit(float(cell)) * F.pow(F.lit(8.0), F.col("__k")))
    for c, lo, hi in (("__cx", "minx", "maxx"), ("__cy", "miny", "maxy")):
        df = df.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / F.col("__size")), F.floor(F.col(hi) / F.col("__size")))))
    return df


def rect_join(left: DataFrame, right: DataFrame, cell: float, on: tuple[str, ...] = (), closed: bool = True, mixed: bool = False) -> DataFrame:
    """Rows of both sides whose boxes (minx, miny, maxx, maxy) meet, each pair once; right columns get the prefix `r_`.

    Each box goes to all cells it touches, and a pair is kept only in the cell of
    the lower left corner of its intersection, so no distinct is needed. `cell`
    should be near the typical box size. Where sizes are `mixed` without a
    bound, as of an outline among tiles, a box over WIDE cells goes to a grid of
    8, 64, ... times that cell instead, and two boxes meet in the grid of the
    larger one: no box then makes more than (WIDE + 1)^2 rows a grid, for one
    written copy of both sides. With
    `closed`, touching edges and corners count; else positive area is needed.
    `on` names further columns that must be equal. Boxes with a null bound meet
    nothing. A crowded cell is a hot join key, which adaptive plans split.
    """
    ok = " and ".join(f"{b} is not null" for b in BOUNDS)
    own = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.expr("maxx - minx"), F.expr("maxy - miny"), F.lit(1e-9)) / F.lit(WIDE * float(cell))) / 3)).cast("int").alias("__own")
    a, b = left.filter(ok).select("*", own if mixed else F.lit(0).alias("__own")), right.filter(ok).select("*", own if mixed else F.lit(0).alias("__own"))
    if mixed:
        a, b = stage(a, "left"), stage(b, "right")  # read twice: for the sizes in use, and for the join
    ka, kb = (_classes(a), _classes(b)) if mixed else ([0], [0])
    a, b = _buckets(a, cell, kb), _buckets(b, cell, ka)
    hidden = ("__own", "__k", "__size", "__cx", "__cy")
    b = b.select([F.col(c).alias(f"r{c}" if c in hidden else f"r_{c}") for c in b.columns])
    cond = (F.col("__k") == F.col("r__k")) & (F.col("__cx") == F.col("r__cx")) & (F.col("__cy") == F.col("r__cy"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"r_{c}"))
    met = a.join(b, cond)
    op = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    met = met.filter(op(F.col("minx"), F.col("r_maxx")) & op(F.col("r_minx"), F.col("maxx")) & op(F.col("miny"), F.col("r_maxy")) & op(F.col("r_miny"), F.col("maxy")))
    met = met.filter(F.col("__k") == F.greatest("__own", "r__own"))
    met = met.filter((F.col("__cx") == F.floor(F.greatest("minx", "r_minx") / F.col("__size"))) & (F.col("__cy") == F.floor(F.greatest("miny", "r_miny") / F.col("__size"))))
    return met.drop(*hidden, *[f"r{c}" for c in hidden])


def rect_semi_join(left: DataFrame, right: DataFrame, key: list[str], cell: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `left` (unique by `key`) whose box meets a box of `right`, touching included."""
    keys = rect_join(left, right.select(*BOUNDS, *on), cell, on).select(*key).distinct()
    return left.join(keys, key, "left_semi")


def shared_area() -> Column:
    """Area of the intersection of the two boxes of a `rect_join` row."""
    w = F.least("maxx", "r_maxx") - F.greatest("minx", "r_minx")
    h = F.least("maxy", "r_maxy") - F.greatest("miny", "r_miny")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
