"""Evaluation records that also stand, exactly or almost, in the training split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions.geometry import NUMBER, with_extent
from terraframe.plans import stage

IOU, CONTAINED, TOLERANCE_PX, TOKEN_PX = 0.8, 0.75, 8, 32
HOT_WORD = 4000  # training words of one hash that one task should meet at most
_OBJECT = rf"^\s*(?:{NUMBER}\s+){{8}}\S"


def split_of(name: Column) -> Column:
    """train, validation or test (trimmed, case ignored, val is validation); anything else null."""
    s = F.lower(F.trim(name))
    return F.when(s.isin("val", "validation"), "validation").when(s.isin("train", "test"), s)


def label_objects(text: Column) -> Column:
    """Objects of a label text as array<struct<cls,l,t,r,b>>, one per readable line.

    A line has eight corner numbers in any order, a class and more fields;
    others are no objects. Line ends may be LF or CR LF. Null gives null.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.rlike(_OBJECT))
    # step by step: what a lambda names is worked out once
    fields = F.transform(lines, lambda s: F.split(F.regexp_replace(s, r"^\s+", ""), r"\s+", 10))
    parts = F.transform(fields, lambda f: F.struct(F.lower(f[8]).alias("cls"), F.slice(f, 1, 8).cast("array<double>").alias("n")))
    ends = lambda g, n, ks: g(*[n[k] for k in ks])
    return F.transform(parts, lambda p: F.struct(
        p["cls"].alias("cls"), ends(F.least, p["n"], (0, 2, 4, 6)).alias("l"), ends(F.least, p["n"], (1, 3, 5, 7)).alias("t"), ends(F.greatest, p["n"], (0, 2, 4, 6)).alias("r"), ends(F.greatest, p["n"], (1, 3, 5, 7)).alias("b")))


def cross_split_pairs(patches: DataFrame, iou: float = IOU, contained: float = CONTAINED, tolerance: int = TOLERANCE_PX) -> DataFrame:
    """(eval_id, train_id) of patches of the same ground with agreeing labels, one in train, one in validation or test.

    A record's words are its objects, taken one by one: neighbours may change
    places within the tolerance, so longer n-grams would lose cases. Each is hashed with its class, its corner
    in steps of 32 px and the ground cell of its patch; evaluation records are
    hashed under every neighbouring value within the tolerance, so no case is
    missed. Training words are scanned against these hashes, partitioned by
    hash, and the containment of each evaluation record in each training record
    and back is counted; words that crowds of training records share are salted. Both must reach `contained`, the extents an
    intersection over union of `iou`. Several objects may share a counterpart.

    Exact copies (same extent, objects and side) are compared once and only the
    result is spread to them. Patches null in id, geometry, labels or split, of
    another split, without area or without objects take no part; repeated rows
    count once; an id in both splits never pairs with itself.
    """
    p = with_extent(patches.select("patch_id", "geometry", split_of(F.col("split_name")).alias("split"), label_objects(F.col("labeltxt")).alias("obj")))
    p = p.filter("patch_id is not null and split is not null and maxx > minx and maxy > miny and size(obj) > 0")
    p = p.withColumn("side", F.when(F.col("split") == "train", "t").otherwise("e")).withColumn("obj", F.array_sort("obj"))
    box = ["minx", "miny", "maxx", "maxy"]
    p = p.withColumn("sig", F.sha2(F.concat_ws("|", *box, F.to_json("obj")), 256))
    p = stage(p.select("patch_id", "side", "sig", "obj", *box).dropDuplicates(["patch_id", "side", "sig"]), "patches")
    kinds = stage(p.groupBy("sig", "side").agg(F.min("patch_id").alias("rep"), F.first("obj").alias("obj"), *[F.first(c).alias(c) for c in box]), "kinds")
    members = p.select("patch_id", "side", "sig").join(kinds.select("sig", "side", "rep"), ["sig", "side"])
    w, cx, cy = F.expr("maxx - minx"), F.expr("(minx + maxx) / 2"), F.expr("(miny + maxy) / 2")
    kinds = kinds.select("rep", "side", *box, F.size("obj").alias("n"), w.alias("w"), cx.alias("cx"), cy.alias("cy"), F.posexplode("obj").alias("no", "o"))
    kinds = kinds.select("*", "o.*").drop("o")
    # equal ground at this iou: widths within 1/iou of each other, centres within (1/iou - 1) of a width
    slack = (1 / iou - 1) * 1.001
    step = F.pow(F.lit(2.0), F.col("k") + 1)
    t = kinds.filter("side = 't'").withColumn("k", F.floor(F.log2("w")).cast("int"))
    t = t.withColumn("gx", F.floor(F.col("cx") / step)).withColumn("gy", F.floor(F.col("cy") / step))
    t = t.withColumn("qx", F.floor(F.col("l") / TOKEN_PX)).withColumn("qy", F.floor(F.col("t") / TOKEN_PX))
    e = kinds.filter("side = 'e'").withColumn("k", F.explode(F.sequence(F.floor(F.log2(F.col("w") * iou * 0.999)).cast("int"), F.floor(F.log2(F.col("w") / iou * 1.001)).cast("int"))))
    reach = F.greatest("w", F.expr("maxy - miny")) * slack
    for g, c in (("gx", "cx"), ("gy", "cy")):
        e = e.withColumn(g, F.explode(F.sequence(F.floor((F.col(c) - reach) / step), F.floor((F.col(c) + reach) / step))))
    for q, c in (("qx", "l"), ("qy", "t")):
        e = e.withColumn(q, F.explode(F.sequence(F.floor((F.col(c) - tolerance) / TOKEN_PX), F.floor((F.col(c) + tolerance) / TOKEN_PX))))
    word = F.xxhash64("cls", "k", "gx", "gy", "qx", "qy")
    cols = ["rep", "n", "no", "cls", "l", "t", "r", "b", *box]
    e = e.select(word.alias("word"), *[F.col(c).alias(f"e_{c}") for c in cols])
    t = t.select(word.alias("word"), *[F.col(c).alias(f"t_{c}") for c in cols])
    near = F.expr("e_cls = t_cls and " + " and ".join(f"abs(e_{c} - t_{c}) <= {tolerance}" for c in "ltrb"))
    inter = F.expr("greatest(0D, least(e_maxx, t_maxx) - greatest(e_minx, t_minx)) * greatest(0D, least(e_maxy, t_maxy) - greatest(e_miny, t_miny))")
    both = F.expr("(e_maxx - e_minx) * (e_maxy - e_miny) + (t_maxx - t_minx) * (t_maxy - t_miny)") - inter
    t, e = _salted(t, e)
    hits = t.join(e, ["word", "salt"]).filter(near & (inter / both >= iou))
    found = hits.groupBy("e_rep", "t_rep", "e_n", "t_n").agg(F.size(F.collect_set("e_no")).alias("e_in"), F.size(F.collect_set("t_no")).alias("t_in"))
    found = found.filter((F.col("e_in") >= F.col("e_n") * contained) & (F.col("t_in") >= F.col("t_n") * contained)).select("e_rep", "t_rep")
    ids = lambda s, n: members.filter(F.col("side") == s).select(F.col("rep").alias(f"{s}_rep"), F.col("patch_id").alias(n))
    out = found.join(ids("e", "eval_id"), "e_rep").join(ids("t", "train_id"), "t_rep")
    return out.filter("eval_id <> train_id").select("eval_id", "train_id").distinct()


def _salted(t: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with `salt`: a word that many training rows have is spread over salts, its evaluation rows go to all of them."""
    crowd = stage(t.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_WORD).select("word", F.ceil(F.col("n") / HOT_WORD).cast("int").alias("salts")), "crowd")
    t = t.join(crowd, "word", "left").withColumn("salt", F.pmod(F.xxhash64("t_rep"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("salts")
    e = e.join(crowd, "word", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return t, e
