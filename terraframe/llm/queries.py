"""Queries over the operators of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions.geometry import with_extent
from terraframe.llm import crosssplit, grouping, leakage, mixing, pieces, spans
from terraframe.operators.spatial import rect_join
from terraframe.plans import held, shared_dir, stage
from terraframe.queries import GRID_SQL, ext_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each patch with the group of all patches it is related to."""
    return grouping.related_patches(table(spark, d, "one_tile"))


@query
def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each patch with its group and its split, 80/10/10 without a torn group."""
    return grouping.assign_splits(p4_found(spark, d))


@query
def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and groups of each split (80, 10 and 10 in a hundred wanted)."""
    return p4_splits(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("patches"), F.countDistinct("group_id").alias("n_groups"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each detection that overlaps another, with the group it belongs to."""
    return grouping.overlapping_detections(table(spark, d, "object_detection"))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group of detections with its size, top score and label."""
    dets = table(spark, d, "object_detection")
    return grouping.group_tops(dets, p5_found(spark, d))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Patches of one piece of ground with agreeing labels on both sides of the train split."""
    pairs = crosssplit.cross_split_pairs(table(spark, d, "one_tile"))
    return pairs.select(F.least("eval_id", "train_id").alias("patch_id_a"), F.greatest("eval_id", "train_id").alias("patch_id_b")).distinct()


@query
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and evaluation patches concerned, per split and dataset of the evaluation patch."""
    tiles = table(spark, d, "one_tile")
    pairs = crosssplit.cross_split_pairs(tiles)
    meta = tiles.select(F.col("patch_id").alias("eval_id"), crosssplit.split_of(F.col("split_name")).alias("split"), "dataset").distinct()
    return pairs.join(meta, "eval_id").groupBy("split", "dataset").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_id").alias("eval_patches"), F.countDistinct("train_id").alias("train_patches"))


def pixel_items(spark: SparkSession, d: str) -> DataFrame:
    """Grid cells and patches as kind, id, ground bounds, res, and width and height in pixels."""
    b = ("minx", "miny", "maxx", "maxy")
    g = with_extent(table(spark, d, "grid").select("cell_id", "raster_id", "geometry", *[F.col(c).alias(f"g_{c}") for c in b]))
    g = g.select(F.lit("grid").alias("kind"), F.col("cell_id").alias("id"), "raster_id", *[F.coalesce(f"g_{c}", c).alias(c) for c in b])
    g = g.join(table(spark, d, "raster").select("raster_id", "res"), "raster_id").drop("raster_id")
    t = with_extent(table(spark, d, "one_tile").select("patch_id", "geometry", "res"))
    t = t.select(F.lit("one_tile").alias("kind"), F.col("patch_id").alias("id"), *b, "res")
    px = lambda lo, hi: F.round(F.try_divide(F.col(hi) - F.col(lo), F.col("res")), 6)
    items = g.unionByName(t).filter("id is not null and res > 0 and not isnan(res)")
    return items.withColumn("width", px("minx", "maxx")).withColumn("height", px("miny", "maxy")).distinct()


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that must be cut: those of which the cutter makes more than one piece."""
    return p6_pieces(spark, d).select("item_kind", "item_id").distinct()


@query
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the oversized cells and patches, cut between labelled objects where possible."""
    items = stage(pieces.oversized(pixel_items(spark, d)), "oversized")
    tiles = table(spark, d, "one_tile").select("patch_id", F.explode(crosssplit.label_objects(F.col("labeltxt"))).alias("o"))
    own = tiles.select(F.lit("one_tile").alias("kind"), F.col("patch_id").alias("id"), "o.l", "o.t", "o.r", "o.b")
    segs = with_extent(table(spark, d, "segments_gdf").select("seg_id", "geometry")).select("minx", "miny", "maxx", "maxy").distinct()
    seen = rect_join(items.filter("kind = 'grid'"), segs, 512.0)
    ground = seen.select("kind", "id", F.expr("(r_minx - minx) / res").alias("l"), F.expr("(maxy - r_maxy) / res").alias("t"), F.expr("(r_maxx - minx) / res").alias("r"), F.expr("(maxy - r_miny) / res").alias("b"))
    out = pieces.cut_items(items, own.unionByName(ground))
    return out.withColumnRenamed("kind", "item_kind").withColumnRenamed("id", "item_id")


@query
def p6_file_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pages written out as giant text files, cut in pieces of at most 4,096 bytes that overlap by 256; of each piece's text the length and digest."""
    at = f"{shared_dir(spark)}/stage-pages-{uuid.uuid4().hex}"
    texts = table(spark, d, "documents").select("text").filter("text is not null")
    held(at)
    texts.write.text(at)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(at).select("path").toLocalIterator()  # one row per giant file
    out = pieces.cut_files(spark, [r.path for r in paths], 4096, 256, 1024)
    return out.select(F.regexp_extract("path", r"part-(\d+)", 1).alias("file"), "piece", "start", "stop", "boundary", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of at least 400 characters that stand on another page too."""
    return spans.shared_spans(table(spark, d, "documents"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """For each page, how many of its characters are shared and in how many stretches."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))
    got = p9_found(spark, d).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("stretches"))
    got = docs.join(got, "doc_id", "left").select("doc_id", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("stretches", F.lit(0)).alias("stretches"))
    return got.withColumn("shared", F.coalesce(F.try_divide(F.col("shared_chars"), F.col("chars")), F.lit(0.0)))


@query
def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Pages without the sentences that stand in an earlier page's stretch too: length and digest of what is kept, characters removed."""
    kept = spans.without_repeats(table(spark, d, "documents"))
    return kept.select("doc_id", F.length("text").alias("kept_chars"), "removed_chars", F.md5("text").alias("digest"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold 20 words or more of a test passage in a row, with the passage."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


@query
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """For each page concerned, the passages that leaked into it."""
    return p7_found(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_set("item_id")).cast("string").alias("items"))


@query
def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Pages that stay once those with a leaked passage are removed."""
    return table(spark, d, "documents").select("doc_id", "source").join(p7_found(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


@query
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of pages: each use of each page, with its place in the global random order."""
    sizes = stage(mixing.sized(table(spark, d, "documents")), "sizes")
    return mixing.mixture(sizes, table(spark, d, "mix_target"))


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources in the mixture."""
    sizes = stage(mixing.sized(table(spark, d, "documents")), "sizes")
    targets = table(spark, d, "mix_target")
    return mixing.actual_shares(mixing.mixture(sizes, targets, shuffled=False), sizes, targets)


# ---- SQL for the same rows, by plain joins and closures

_OBJ = r"""o as (select patch_id, cast(list_min([f[1], f[3], f[5], f[7]]::double[]) as double) as l, cast(list_min([f[2], f[4], f[6], f[8]]::double[]) as double) as t, cast(list_max([f[1], f[3], f[5], f[7]]::double[]) as double) as r, cast(list_max([f[2], f[4], f[6], f[8]]::double[]) as double) as b, lower(f[9]) as cls, no
 from (select patch_id, no, regexp_split_to_array(trim(ls[no], chr(32) || chr(9) || chr(13)), '\s+') as f from (select patch_id, ls, unnest(range(1, len(ls) + 1)) as no from (select patch_id, regexp_split_to_array(any_value(labeltxt), '\r?\n') as ls from one_tile where labeltxt is not null group by patch_id))) where len(f) >= 9 and regexp_full_match(array_to_string(f[1:8], ' '), '[-+0-9. eE]+'))"""
SQL["p2_found"] = f"""with t as (select distinct patch_id, case when lower(trim(split_name)) = 'train' then 't' when lower(trim(split_name)) in ('val', 'validation', 'test') then 'e' end as side, minx, miny, maxx, maxy from (select patch_id, split_name, {ext_sql()} from one_tile) where minx is not null), {_OBJ}, n as (select patch_id, count(*) as n from o group by patch_id),
 pr as (select a.patch_id as a, b.patch_id as b, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) as i, (a.maxx - a.minx) * (a.maxy - a.miny) + (b.maxx - b.minx) * (b.maxy - b.miny) as s from t a join t b on a.side = 'e' and b.side = 't' and a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy),
 hit as (select pr.a, pr.b, x.no as xa, y.no as yb from pr join o x on x.patch_id = pr.a join o y on y.patch_id = pr.b and x.cls = y.cls and abs(x.l - y.l) <= 8 and abs(x.t - y.t) <= 8 and abs(x.r - y.r) <= 8 and abs(x.b - y.b) <= 8 where pr.i / (pr.s - pr.i) >= 0.8e0),
 k as (select a, b, count(distinct xa) as na, count(distinct yb) as nb from hit group by a, b)
select least(a, b) as patch_id_a, greatest(a, b) as patch_id_b from k join n x on x.patch_id = a join n y on y.patch_id = b where na >= x.n * 0.75e0 and nb >= y.n * 0.75e0"""
_NAME = r"""regexp_extract(lower(trim(regexp_replace(replace(url_decode(replace({p}, '+', '%2B')), '\', '/'), '^.*/', ''))), '^.*?__(.*)__', 1)"""
SQL["p4_found"] = f"""with recursive t as (select distinct patch_id as id, minx, miny, maxx, maxy, {_NAME.format(p='images_path')} as r1, {_NAME.format(p='labeltxt_path')} as r2 from (select patch_id, images_path, labeltxt_path, {ext_sql()} from one_tile)),
 names as (select distinct id, unnest([r1, r2]) as r from t), e as (select distinct a.id as a, b.id as b from t a join t b on a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy union select a.id, b.id from names a join names b on a.r = b.r and a.r <> ''),
 reach(id, other) as (select id, id from t union select reach.id, e.b from reach join e on e.a = reach.other)
select id as patch_id, min(other) as group_id from reach group by id"""
SQL["p5_found"] = f"""with recursive t as (select distinct det_id as id, cls, minx, miny, maxx, maxy from (select det_id, lower(trim(label)) as cls, score, {ext_sql()} from object_detection where score > 0.5e0 and not isnan(score) and label is not null) where minx is not null),
 e as (select a.id as a, b.id as b from t a join t b on a.cls = b.cls and a.id <> b.id and a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy), reach(id, other) as (select a, a from e union select reach.id, e.b from reach join e on e.a = reach.other)
select id as det_id, min(other) as group_id from reach group by id"""
SQL["p6_found"] = f"""with {GRID_SQL}, i as (select 'grid' as item_kind, cell_id as item_id, minx, miny, maxx, maxy, res from cells join raster using (raster_id) union all select 'one_tile', patch_id, minx, miny, maxx, maxy, res from (select patch_id, res, {ext_sql()} from one_tile))
select distinct item_kind, item_id from i where res > 0 and (round((maxx - minx) / res, 6) > 512 or round((maxy - miny) / res, 6) > 512)"""
SQL["p6_pieces"] = f"""with recursive {GRID_SQL}, it as (select distinct kind, id, minx, maxy, res, round((maxx - minx) / res, 6) as w, round((maxy - miny) / res, 6) as h, miny, maxx from (select 'grid' as kind, cell_id as id, minx, miny, maxx, maxy, res from cells join raster using (raster_id) union all select 'one_tile', patch_id, minx, miny, maxx, maxy, res from (select patch_id, res, {ext_sql()} from one_tile)) where res > 0 and minx is not null),
 big as (select * from it where greatest(w, h) > 512), {_OBJ}, sg as (select distinct minx, miny, maxx, maxy from (select {ext_sql()} from segments_gdf) where minx is not null),
 ob as (select kind, id, l, t, r, b from big join o on kind = 'one_tile' and id = o.patch_id union all select kind, id, (s.minx - big.minx) / res, (big.maxy - s.maxy) / res, (s.maxx - big.minx) / res, (big.maxy - s.miny) / res from big join sg s on kind = 'grid' and s.minx <= big.maxx and s.maxx >= big.minx and s.miny <= big.maxy and s.maxy >= big.miny),
 ax as (select distinct kind, id, 'x' as axis, w as len from big union select distinct kind, id, 'y', h from big), sp as (select kind, id, 'x' as axis, l as a, r as b from ob union all select kind, id, 'y', t, b from ob),
 px as (select kind, id, axis, len, unnest(range(0, cast(ceil(len) as bigint) + 1)) as x from ax), cutting as (select distinct kind, id, axis, x from px join sp using (kind, id, axis) where a < x and x < b),
 fr as (select px.*, cutting.x is null as free from px left join cutting using (kind, id, axis, x)), nx as (select kind, id, axis, len, x, free, max(case when free then x end) over (partition by kind, id, axis order by x range between 1 following and 448 following) as far from fr),
 walk(kind, id, axis, len, k, c, nat) as (select kind, id, axis, len, cast(0 as bigint), cast(64 as bigint), true from ax union all select w.kind, w.id, w.axis, w.len, w.k + 1, coalesce(nx.far, w.c + 448), nx.far is not null from walk w join nx on nx.kind = w.kind and nx.id = w.id and nx.axis = w.axis and nx.x = w.c where w.c + 448 < w.len),
 pc as (select kind, id, axis, k, cast(lag(c) over (partition by kind, id, axis order by k) - 64 as double) as lo, cast(c as double) as hi, nat from walk union all select kind, id, axis, max(k) + 1, cast(max(c) - 64 as double), any_value(len), true from walk group by kind, id, axis)
select x.kind as item_kind, x.id as item_id, x.k as piece_x, y.k as piece_y, x.lo as x0, y.lo as y0, x.hi as x1, y.hi as y1, x.nat and y.nat as natural from pc x join pc y on x.kind = y.kind and x.id = y.id where x.axis = 'x' and y.axis = 'y' and x.k > 0 and y.k > 0"""
SQL["p9_found"] = """with w as (select doc_id, i - 1 as pos, md5(substr(text, i, 400)) as h from (select doc_id, text, unnest(range(1, length(text) - 398)) as i from documents where length(text) >= 400)),
 s as (select doc_id, pos from w where h in (select h from w group by h having min(doc_id) < max(doc_id))),
 g as (select *, case when pos <= lag(pos) over (partition by doc_id order by pos) + 400 then 0 else 1 end as new from s),
 k as (select *, sum(new) over (partition by doc_id order by pos) as k from g)
select doc_id, min(pos) as span_start, max(pos) + 400 as span_end from k group by doc_id, k"""
SQL["p9_shares"] = f"""with sp as ({SQL['p9_found']}), g as (select doc_id, cast(sum(span_end - span_start) as bigint) as s, count(*) as n from sp group by doc_id), d as (select doc_id, length(text) as chars from documents)
select doc_id, chars, coalesce(s, 0) as shared_chars, coalesce(n, 0) as stretches, case when chars > 0 then coalesce(s, 0) / cast(chars as double) else 0 end as shared from d left join g using (doc_id)"""
SQL["p5_groups"] = SQL["p5_found"].replace("select id as det_id, min(other) as group_id from reach group by id", """, gr as (select id as det_id, min(other) as group_id from reach group by id),
 ds as (select distinct det_id, score, lower(trim(label)) as label from object_detection where score is not null and not isnan(score))
select group_id, count(distinct det_id) as n_detections, max(score) as top_score, arg_max(label, {'s': score, 'd': -det_id}) as top_label, arg_max(det_id, {'s': score, 'd': -det_id}) as top_det_id from gr join ds using (det_id) group by group_id""")
SQL["p2_report"] = SQL["p2_found"].replace("select least(a, b) as patch_id_a, greatest(a, b) as patch_id_b from k", """, meta as (select distinct patch_id, case lower(trim(split_name)) when 'val' then 'validation' else lower(trim(split_name)) end as split, dataset from one_tile)
select split, dataset, count(*) as pairs, count(distinct a) as eval_patches, count(distinct b) as train_patches from k join meta on meta.patch_id = a""") + " group by split, dataset"
SQL["p4_splits"] = SQL["p4_found"].replace("select id as patch_id, min(other) as group_id from reach group by id", """, gr as (select id as patch_id, min(other) as group_id from reach group by id), gz as (select group_id, count(*) as size from gr group by group_id),
 sq as (select *, row_number() over (order by size desc, group_id) as k, row_number() over (partition by size order by group_id) as pos from gz),
 st(k, a, b, c, size, pick) as (select cast(0 as bigint), 0.8e0 * sum(size), 0.1e0 * sum(size), 0.1e0 * sum(size), cast(0 as bigint), '' from gz
  union all select sq.k, a - case when p = 'train' then sq.size else 0 end, b - case when p = 'validation' then sq.size else 0 end, c - case when p = 'test' then sq.size else 0 end, sq.size, p from (select *, case when a >= b and a >= c then 'train' when b >= c then 'validation' else 'test' end as p from st) s join sq on sq.k = s.k + 1),
 lim as (select size, count(*) filter (pick = 'train') as t, count(*) filter (pick = 'validation') as v from st where k > 0 group by size)
select patch_id, group_id, case when pos <= t then 'train' when pos <= t + v then 'validation' else 'test' end as split from gr join sq using (group_id) join lim using (size)""")
SQL["p4_shares"] = f"select split, count(*) as patches, count(distinct group_id) as n_groups from ({SQL['p4_splits']}) group by split"
