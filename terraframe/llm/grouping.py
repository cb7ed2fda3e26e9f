"""Groups of related patches and of overlapping detections, and splits that keep groups whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions.geometry import with_extent
from terraframe.llm.components import hierarchical_components, star_links, strip_components
from terraframe.llm.overlap import overlap_links
from terraframe.plans import stage

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def raster_of_path(path: Column) -> Column:
    """Raster name in a path `<stem>__<raster>__<kind>.<ext>`: between the first and the last `__` of the file name.

    Percent-decoded, either separator, trimmed, lower case. Null where the path
    is null or names none. A `+` stays a `+`; a text that is no valid
    percent-code is taken as it stands.
    """
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)
    name = F.lower(F.trim(F.element_at(F.split(F.regexp_replace(plain, r"\\", "/"), "/"), -1)))
    raster = F.trim(F.regexp_extract(name, r"^.*?__(.*)__", 1))
    return F.when(raster != "", raster)


def related_patches(patches: DataFrame) -> DataFrame:
    """(patch_id, group_id) of each patch: same raster in either path, or extents that share area, passed on.

    Repeated ids count once (all their rows relate); null fields relate to
    nothing; an unrelated patch is its own group; null ids have no row.
    """
    p = with_extent(patches.select("patch_id", "geometry", "images_path", "labeltxt_path").filter("patch_id is not null"))
    p = stage(p.select("patch_id", "minx", "miny", "maxx", "maxy", raster_of_path(F.col("images_path")).alias("r1"), raster_of_path(F.col("labeltxt_path")).alias("r2")).distinct(), "patches")
    names = p.select(F.col("patch_id").alias("id"), F.explode(F.array("r1", "r2")).alias("raster")).distinct()
    links = star_links(names, "id", ["raster"]).unionByName(overlap_links(p, "patch_id", []))
    groups = hierarchical_components(links)
    ids = p.select(F.col("patch_id").cast("long").alias("id")).distinct()
    return ids.join(groups, "id", "left").select(F.col("id").alias("patch_id"), F.coalesce("group_id", "id").alias("group_id"))


def quotas(sizes: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """Largest first, each group to the split furthest below target, for groups counted by size.

    sizes: (size, number of groups). Gives (size, split, from, to): groups of
    that size ranked from..to-1 go to that split. Groups of one size are handled
    together, as greedy would take them one by one; ties go to the first split.
    """
    names, total = list(shares), sum(s * c for s, c in sizes)
    short = np.array([shares[n] / sum(shares.values()) * total for n in names])
    out = []
    for size, count in sorted(sizes, reverse=True):
        lo, hi = short.min() - size * (count + 1), short.max() + size
        for _ in range(200):  # the deficit at which `count` groups have been handed out
            mid = (lo + hi) / 2
            if np.maximum(0, np.ceil((short - mid) / size)).sum() > count:
                lo = mid
            else:
                hi = mid
        take = np.maximum(0, np.ceil((short - hi) / size)).astype(int)
        while take.sum() < count:
            take[int(np.argmax(short - take * size))] += 1
        at = 0
        for n, t in zip(names, take, strict=True):
            if t:
                out.append((int(size), n, at, at + int(t)))
            at += int(t)
        short = short - take * size
    return out


def assign_splits(groups: DataFrame, id_col: str = "patch_id", group_col: str = "group_id", shares: dict[str, float] | None = None) -> DataFrame:
    """(id, group, split): whole groups to splits, greedy largest first, near the given proportions.

    The driver sees only how many groups there are of each size (at most about
    the root of twice the rows). Groups of a size are ranked by a distributed
    sort: partition offsets plus positions, no global window. Rows with a null
    group form no group and get no row. No rows in: no rows out.
    """
    shares = shares or SPLITS
    spark = groups.sparkSession
    g = groups.select(F.col(id_col).alias("member"), F.col(group_col).alias("grp")).filter("grp is not null")
    named = lambda df: df.select(F.col("member").alias(id_col), F.col("grp").alias(group_col), "split")
    size = g.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    ranked = stage(size.repartitionByRange(F.col("size").desc(), "grp").sortWithinPartitions(F.col("size").desc(), "grp")
                   .withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "sizes")
    runs = ranked.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).collect()
    per_size: dict[int, list] = {}
    for r in sorted(runs, key=lambda r: (r["size"], r["part"])):
        per_size.setdefault(r["size"], []).append(r)
    if not per_size:
        return named(g.withColumn("split", F.lit(None).cast("string")))
    plan = []
    for s, name, lo, hi in quotas([(s, sum(r["n"] for r in rs)) for s, rs in per_size.items()], shares):
        at = 0
        for r in per_size[s]:
            a, b = max(lo, at), min(hi, at + r["n"])
            if a < b:
                plan.append((r["size"], r["part"], name, r["first"] + a - at, r["first"] + b - at))
            at += r["n"]
    slots = spark.createDataFrame(plan, "size long, part int, split string, lo long, hi long")
    split = ranked.join(slots, ["size", "part"]).filter("seq >= lo and seq < hi").select("grp", "split")
    return named(g.join(split, "grp"))


def overlapping_detections(dets: DataFrame, least_score: float = 0.5) -> DataFrame:
    """(det_id, group_id) of each detection that matches another: score above `least_score`, equal label, shared area.

    Labels are trimmed, case ignored. Null or NaN scores, null labels, null or
    empty geometries take no part; repeated ids count once.
    """
    d = dets.select("det_id", "geometry", "score", F.lower(F.trim("label")).alias("cls"))
    d = with_extent(d.filter(F.expr(f"score > {least_score!r}D and not isnan(score) and cls is not null")))
    links = overlap_links(d, "det_id", ["cls"])
    return strip_components(links).select(F.col("id").alias("det_id"), "group_id")


def group_tops(dets: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, n_detections, top_score, top_label, top_det_id) of each group; ties go to the smaller det_id."""
    d = dets.select("det_id", "score", F.lower(F.trim("label")).alias("label")).filter("det_id is not null and not isnan(score)").distinct()
    return d.join(groups, "det_id").groupBy("group_id").agg(
        F.countDistinct("det_id").alias("n_detections"), F.max("score").alias("top_score"),
        F.max_by("label", F.struct("score", -F.col("det_id"))).alias("top_label"),
        F.max_by("det_id", F.struct("score", -F.col("det_id"))).alias("top_det_id"))
