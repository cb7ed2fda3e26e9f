"""Detection and segmentation measures, dataset filters and geographic splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraframe.functions.geometry import BOUNDS
from terraframe.operators.spatial import rect_join, shared_area
from terraframe.plans import stage


def pixel_iou(pixels: DataFrame, by: str, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn and iou per class, from boolean columns; no pixel of either kind: null."""
    t, p = F.col(truth), F.col(predicted)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    g = pixels.groupBy(by).agg(n(t & p)("tp"), n(~t & p)("fp"), n(t & ~p)("fn"))
    return g.withColumn("iou", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp") + F.col("fn")).cast("double")))


def average_precision(predictions: DataFrame, truths: DataFrame, cell: float, iou: float = 0.5) -> DataFrame:
    """Average precision per label: label, predictions, truths, hits, ap.

    predictions: id, label, score, bounds; truths: id, label, bounds. Each
    prediction goes to its best truth (largest intersection over union, at
    least `iou`, ties to the smaller id); of the predictions of one truth the
    best scored is a hit. ap is the sum of the precision at each hit over the
    number of truths.
    """
    predictions = stage(predictions.select("id", "label", "score", *BOUNDS), "predictions")  # both are needed twice
    truths = stage(truths.select("id", "label", *BOUNDS), "truths")
    met = rect_join(predictions, truths, cell, on=("label",))
    a = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    b = (F.col("r_maxx") - F.col("r_minx")) * (F.col("r_maxy") - F.col("r_miny"))
    met = met.withColumn("iou", F.try_divide(shared_area(), a + b - shared_area())).filter(F.col("iou") >= iou)
    best = met.groupBy("id").agg(F.max_by("r_id", F.struct("iou", -F.col("r_id"))).alias("truth"))
    ranked = predictions.select("id", "label", "score").join(best, "id", "left")
    first = ranked.filter("truth is not null").groupBy("label", "truth").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id")).select("id", F.lit(1).alias("hit"))
    ranked = ranked.join(first, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    order = [F.col("label"), F.desc("score"), F.col("id")]
    ranked = stage(ranked, "scored")  # range bounds are sampled from what is written
    ranked = stage(ranked.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    # a label may hold most rows: ranks are positions within a sorted range plus what the ranges before it hold
    sums = ranked.groupBy("label", "part").agg(F.count(F.lit(1)).alias("pn"), F.sum("hit").alias("pk"))
    before = W.partitionBy("label").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    sums = sums.select("label", "part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("pk").over(before), F.lit(0)).alias("k0"))
    inside = W.partitionBy("label", "part").orderBy(F.desc("score"), "id")
    ranked = ranked.withColumn("n", F.row_number().over(inside)).withColumn("k", F.sum("hit").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.join(sums, ["label", "part"]).withColumn("n", F.col("n") + F.col("n0")).withColumn("k", F.col("k") + F.col("k0"))
    got = ranked.groupBy("label").agg(F.count(F.lit(1)).alias("predictions"), F.sum("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, F.col("k") / F.col("n"))).alias("s"))
    all_ = truths.groupBy("label").agg(F.count(F.lit(1)).alias("truths"))
    out = all_.join(got, "label", "left")
    return out.select("label", F.coalesce("predictions", F.lit(0)).alias("predictions"), "truths", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("s", F.lit(0.0)) / F.col("truths")).alias("ap"))


def select_objects(objects: DataFrame, classes: list[str] | None = None, qualities: str | None = "1,2", band: int | None = None) -> DataFrame:
    """Objects of the given classes, quality classes (as '1,2') and band (from 0); None does not filter."""
    if classes:
        objects = objects.filter(F.lower("label").isin([c.lower() for c in classes]))
    if qualities:
        objects = objects.filter(F.col("dfm").isin([int(q) for q in qualities.split(",")]))
    return objects if band is None else objects.filter(F.col("band") == band)


def keep_patches(patches: DataFrame, objects: DataFrame, key: str, keep_empty: bool) -> DataFrame:
    """Patches that have an object, or all."""
    return patches if keep_empty else patches.join(objects.select(key).distinct(), key, "left_semi")


def spatial_split(df: DataFrame, block: float, shares: tuple[int, int, int] = (60, 20, 20)) -> DataFrame:
    """`split` by ground block, so that one block is never torn: train, validation or test in the given percent."""
    bx, by = F.floor(F.col("minx") / block).cast("long"), F.floor(F.col("miny") / block).cast("long")
    k = F.pmod(bx * 7919 + by * 104729, F.lit(100))
    return df.withColumn("split", F.when(k < shares[0], "train").when(k < shares[0] + shares[1], "validation").otherwise("test"))
