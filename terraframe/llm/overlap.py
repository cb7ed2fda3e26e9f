"""Links between boxes that share area: enough of them to connect each group, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.llm.components import forest, star_links
from terraframe.plans import stage

HOT_CELL = 2000  # boxes that one task compares within one cell
_BOX = ["minx", "miny", "maxx", "maxy"]
_CELL = ["key", "size", "cx", "cy"]


def sweep(cell: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of boxes of one cell that share area; rows are sorted by cell, then x0."""
    at, step, us, vs = np.arange(len(cell)), 0, [], []
    while len(at):
        step += 1
        at = at[at + step < len(cell)]
        to = at + step
        live = (cell[at] == cell[to]) & (x0[to] < x1[at])
        at, to = at[live], to[live]
        meet = np.minimum(y1[at], y1[to]) > np.maximum(y0[at], y0[to])
        us.append(at[meet])
        vs.append(to[meet])
    return (np.concatenate(us), np.concatenate(vs)) if us else (at, at)


def _cell_links(rows: DataFrame) -> DataFrame:
    """Sweep of each cell; per cell only the links of a spanning forest come out."""
    def links(p: pd.DataFrame, cell: np.ndarray) -> pd.DataFrame:
        i, j = sweep(cell, *(p[c].to_numpy() for c in _BOX))
        if not len(i):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        ids = p["id"].to_numpy()
        v, r = forest(ids[i], ids[j])
        return pd.DataFrame({"u": r[v != r], "v": v[v != r]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in batches:
            if held is not None:
                p = pd.concat([held, p], ignore_index=True)
            if not len(p):
                continue
            k = p[_CELL].to_numpy()
            cell = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
            last = int(np.searchsorted(cell, cell[-1]))
            held = p.iloc[last:]
            if last:
                yield links(p.iloc[:last], cell[:last])
        if held is not None and len(held):
            yield links(held, np.zeros(len(held), dtype=int))

    return rows.select("id", *_CELL, *_BOX).repartition(*_CELL).sortWithinPartitions(*_CELL, "minx").mapInPandas(run, "u bigint, v bigint")


def overlap_links(df: DataFrame, id_col: str, key_cols: list[str], hot_cell: int = HOT_CELL) -> DataFrame:
    """(u, v) that connect just those rows which share positive area under equal keys, directly or over others.

    df has minx, miny, maxx, maxy. Equal boxes are joined as stars first. The
    rest is hashed to square cells of a size near their own (powers of eight;
    smaller boxes also enter the cells of larger sizes in use) and swept cell by
    cell. A cell with more than `hot_cell` boxes is cut in 16 until its parts
    are small; where a box covers a part wholly, all in it share area with it
    and are joined as a star without comparing.

    Rows that are null in id, key or a bound, and boxes without area, link to nothing.
    """
    d = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(*key_cols).alias("key") if key_cols else F.lit(0).cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in _BOX], *[F.col(c).isNull().alias(f"__n{i}") for i, c in enumerate(key_cols)])
    d = d.filter("id is not null and maxx > minx and maxy > miny and not isnan(maxx) and not isnan(maxy)")
    for i in range(len(key_cols)):
        d = d.filter(~F.col(f"__n{i}"))
    d = stage(d.select("id", "key", *_BOX).distinct(), "boxes")
    same = ["key", *_BOX]
    kinds = stage(d.groupBy(*same).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "kinds")
    twins = star_links(d.join(stage(kinds.filter("n > 1").select(*same), "equal"), same, "left_semi"), "id", same)
    d = kinds.drop("n")
    d = d.withColumn("lv", (F.ceil(F.log2(F.greatest(F.expr("maxx - minx"), F.expr("maxy - miny"))) / 3) * 3).cast("int"))
    levels = sorted(r.lv for r in d.select("lv").distinct().collect())  # one per power of eight
    d = d.withColumn("lv", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: v >= F.col("lv"))))
    d = d.withColumn("size", F.pow(F.lit(2.0), F.col("lv"))).drop("lv")
    # a box that ends just at a cell's edge has no area beyond it
    d = d.withColumn("cx", F.explode(F.expr("sequence(floor(minx / size), greatest(floor(minx / size), ceil(maxx / size) - 1))")))
    d = d.withColumn("cy", F.explode(F.expr("sequence(floor(miny / size), greatest(floor(miny / size), ceil(maxy / size) - 1))")))
    rows, found = stage(d, "cells"), twins
    for depth in range(20):
        stats = rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_cell).select(*_CELL)
        hot = stage(stats, "hot")
        if hot.isEmpty() or depth == 19:
            return found.unionByName(_cell_links(rows))
        found = found.unionByName(_cell_links(rows.join(hot, _CELL, "left_anti")))
        part = rows.join(hot, _CELL, "left_semi").withColumn("part", F.col("size") / 4)
        for c, lo, hi in (("cx", "minx", "maxx"), ("cy", "miny", "maxy")):
            part = part.withColumn(c, F.explode(F.expr(
                f"filter(sequence({c} * 4, {c} * 4 + 3), k -> k * part < {hi} and (k + 1) * part > {lo})")))
        part = part.withColumn("size", F.col("part")).drop("part")
        part = part.withColumn("whole", F.expr("minx <= cx * size and miny <= cy * size and maxx >= (cx + 1) * size and maxy >= (cy + 1) * size"))
        part = stage(part, "parts")
        covered = stage(part.groupBy(*_CELL).agg(F.min("id").alias("m"), F.max("whole").alias("w")).filter("w").drop("w"), "covered")
        found = found.unionByName(part.join(covered, _CELL).filter("id <> m").select(F.col("m").alias("u"), F.col("id").alias("v")))
        rows = part.join(covered, _CELL, "left_anti").drop("whole")
    return found
