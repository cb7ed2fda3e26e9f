"""Connected groups of pairwise links, two ways, with nothing unbounded in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions.labels import least_roots
from terraframe.plans import stage

TASK_EDGES = 500_000  # links that one task may solve alone (about 50 MB)
STRIP_EDGES = 250_000  # links that one task may strip alone (about 100 MB)
MERGE_AT = 1 << 18  # links a task gathers at least before it merges them into its forest


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links and, for each, the smallest vertex of its tree."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, ids[least_roots(len(ids), ends[: len(u)], ends[len(u):])]


def local_forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: (v, r), each vertex of the partition with its root.

    Links are gathered until they are as many as the forest has vertices, then
    merged into it: memory follows the vertices of the partition, and each link
    is sorted a bounded number of times, however many batches come.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us, vs, n = [], [], 0
        held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for e in batches:
            us.append(e["u"].to_numpy(np.int64))
            vs.append(e["v"].to_numpy(np.int64))
            n += len(e)
            if n >= max(MERGE_AT, len(held[0])):
                held = forest(np.concatenate([*us, held[0]]), np.concatenate([*vs, held[1]]))
                us, vs, n = [], [], 0
        if n or len(held[0]):
            held = forest(np.concatenate([*us, held[0]]), np.concatenate([*vs, held[1]])) if n else held
            yield pd.DataFrame({"v": held[0], "r": held[1]})

    return edges.select("u", "v").mapInPandas(run, "v bigint, r bigint")


def clean(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Links as (u, v) with u < v, each once; nulls and self-links dropped."""
    e = edges.select(F.least(F.col(u), F.col(v)).cast("long").alias("u"), F.greatest(F.col(u), F.col(v)).cast("long").alias("v"))
    return e.filter("u < v").distinct()


def contract(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, r) for each vertex of the links by repeated contraction, fully distributed.

    Each round every vertex joins its neighbour of the least random rank; the
    links are rewritten to the joined vertices. About half the vertices go per
    round, whatever the graph (ranks change each round). Once the links fit one
    task (`task_edges`), one task ends it. r is any vertex of the group.
    """
    steps: list[DataFrame] = []
    e = stage(clean(edges), "links")
    rounds = 0
    while e.count() > task_edges:
        rounds += 1
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64(F.col("v"), F.lit(rounds)).alias("h"), "v")).alias("b"))
        own = F.struct(F.xxhash64(F.col("u"), F.lit(rounds)).alias("h"), F.col("u").alias("v"))
        to = stage(best.select("u", F.least(F.col("b"), own)["v"].alias("p")), "to")
        steps.append(to)
        for side in ("u", "v"):
            e = e.join(to.select(F.col("u").alias(side), F.col("p")), side).withColumn(side, F.col("p")).drop("p")
        e = stage(clean(e), "links")
    labels = local_forest(e.coalesce(1))
    for to in reversed(steps):
        labels = stage(to.join(labels.withColumnRenamed("v", "p"), "p", "left").select(
            F.col("u").alias("v"), F.coalesce("r", "p").alias("r")), "labels")
    return labels


def _ends(e: DataFrame) -> DataFrame:
    """u, deg, n1, n2: each vertex with its number of neighbours and the least and greatest of them."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min("v").alias("n1"), F.max("v").alias("n2"))


def rank_chains(middles: DataFrame) -> DataFrame:
    """(u, p, far): the two ends of the chain that each vertex of two neighbours (u, n1, n2) lies in; p the lesser end.

    List ranking by pointer doubling: from each vertex one walk in either
    direction; in a round a walk is lengthened by the walk that starts where it
    has come to, so a chain of n vertices takes about log2 n rounds. A walk ends
    at the first vertex that is none of `middles`. Closed rings have no end and
    give no row: once a round ends no walk, all that are open go round in rings.
    """
    walk = middles.select(F.explode(F.array(F.struct(F.col("n1").alias("a"), F.col("n2").alias("b")), F.struct(F.col("n2").alias("a"), F.col("n1").alias("b")))).alias("w"), "u")
    walk = stage(walk.select(F.col("w.a").alias("a"), "u", F.col("u").alias("ta"), F.col("w.b").alias("tu"), F.lit(True).alias("open")), "walks")
    ended, left, rounds = walk.limit(0), walk.count(), 0
    while left:
        rounds += 1
        # of the walks already ended, those matter that an open one has come to
        onto = walk.unionByName(ended).select(F.col("a").alias("ta"), F.col("u").alias("tu"), F.col("ta").alias("na"), F.col("tu").alias("nu"), F.col("open").alias("further"))
        walk = walk.join(onto, ["ta", "tu"], "left").select(
            "a", "u", F.coalesce("na", "ta").alias("ta"), F.when(F.col("nu").isNull(), F.col("tu")).otherwise(F.col("nu")).alias("tu"), F.coalesce("further", F.lit(False)).alias("open"))
        walk = stage(walk, "walks")
        ended = ended.unionByName(walk.filter("not open"))
        walk = walk.filter("open")
        now = walk.count()
        if now == left:
            break
        left = now
    ends = ended.groupBy("u").agg(F.min("tu").alias("p"), F.max("tu").alias("far"), F.count(F.lit(1)).alias("n"))
    return ends.filter("n = 2").select("u", "p", "far")


def strip_in_task(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stripping of `strip_components` on the links one task holds: its vertices and, for each, the least of its group."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, a, b = len(ids), at[: len(u)], at[len(u):]
    up, removed = np.arange(n), []

    def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
        a, b = k // n, k % n
        return a[a != b], b[a != b]

    a, b = distinct(a, b)
    while True:
        deg = np.bincount(np.concatenate([a, b]), minlength=n)
        x, y = np.where(deg[b] == 1, b, a), np.where(deg[b] == 1, a, b)  # of a lone pair b, the greater
        leaf = deg[x] == 1
        if leaf.any():
            up[x[leaf]] = y[leaf]
            removed.append(x[leaf])
            a, b = a[~leaf], b[~leaf]
            deg = np.bincount(np.concatenate([a, b]), minlength=n)
        # list ranking: walks over the links, either way; a walk to a vertex of two neighbours goes on by its other link
        m, src, to = len(a), np.concatenate([a, b]), np.concatenate([b, a])
        out = np.argsort(src, kind="stable")
        middle = np.flatnonzero(deg[to] == 2)
        first = np.searchsorted(src[out], to[middle])
        one, two = out[first], out[np.minimum(first + 1, 2 * m - 1)]
        jump = np.full(2 * m, -1)
        jump[middle] = np.where(one == (middle + m) % (2 * m), two, one) if m else one
        for _ in range(m.bit_length() + 2):
            on = np.flatnonzero(jump >= 0)
            to[on], jump[on] = to[jump[on]], jump[jump[on]]
        chained = np.flatnonzero((deg[src] == 2) & (jump < 0))  # what still goes on stands in a ring
        if len(chained):
            end = np.full(n, n)
            np.minimum.at(end, src[chained], to[chained])
            gone = np.unique(src[chained])
            up[gone] = end[gone]
            removed.append(gone)
            fold = np.arange(n)
            fold[gone] = end[gone]
            a, b = distinct(fold[a], fold[b])
        if not leaf.any() and not len(chained):
            break
    root = least_roots(n, a, b)
    for gone in reversed(removed):
        root[gone] = root[up[gone]]
    least = np.full(n, n)
    np.minimum.at(least, root, np.arange(n))
    return ids, ids[least[root]]


def _one_task(e: DataFrame) -> DataFrame:
    """(v, r) of links that fit one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches]
        if sum(len(x) for x, _ in held):
            v, r = strip_in_task(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pd.DataFrame({"v": v, "r": r})

    return e.select("u", "v").coalesce(1).mapInPandas(run, "v bigint, r bigint")


def strip_components(edges: DataFrame, u: str = "u", v: str = "v", task_edges: int = STRIP_EDGES) -> DataFrame:
    """(id, group_id) for each vertex of the links; group_id is the smallest id of the group.

    Rounds of stripping, until no vertex of one neighbour and no chain is left,
    whatever the size: vertices of one neighbour are taken off (of a lone pair
    the greater); then the vertices of two neighbours are ranked along their
    chains (`rank_chains`) and each chain is replaced by one link between its
    ends. What is left, the core, where all have three neighbours or more or
    stand in a closed ring, is solved by `contract`; then the removed vertices
    get the label of the vertex they were folded into, round by round backwards.
    Once at most `task_edges` links are left (after a first round at least), one
    task does the further rounds in the same way (`strip_in_task`).

    Links may repeat or come in either direction; null ends and self-links give
    nothing, so a vertex with only such links has no row. No links: no rows.
    A group or hub of any size is fine: no step gathers a group or a
    neighbourhood, all are aggregations with map-side combine and joins.
    """
    e, removed = stage(clean(edges, u, v), "links"), []
    while True:
        rounds = len(removed)
        ends = stage(_ends(e).filter("deg <= 2"), "ends")
        kinds = {r["deg"] for r in ends.select("deg").distinct().collect()}  # 1 and 2 at most
        if 1 in kinds:
            leaf = ends.filter("deg = 1").groupBy(F.least("u", "n1").alias("a"), F.greatest("u", "n1").alias("b")).agg(F.max(F.struct(F.col("u").alias("u"), F.col("n1").alias("p"))).alias("x"))
            gone = stage(leaf.select("a", "b", "x.u", "x.p"), "gone")
            removed.append(gone.select("u", "p"))
            e = stage(e.join(gone.select(F.col("a").alias("u"), F.col("b").alias("v")), ["u", "v"], "left_anti"), "links")
            ends = stage(_ends(e).filter("deg = 2"), "ends")
        if not (middles := ends.filter("deg = 2")).isEmpty():
            gone = stage(rank_chains(middles), "gone")
            if not gone.isEmpty():
                removed.append(gone.select("u", "p"))
                for side in ("u", "v"):
                    e = e.join(gone.select(F.col("u").alias(side), "p"), side, "left").withColumn(side, F.coalesce("p", side)).drop("p")
                e = stage(clean(e), "links")
        if len(removed) == rounds or e.count() <= task_edges:
            break
    labels = _one_task(e) if e.count() <= task_edges else contract(e, max(task_edges, 1))
    for gone in reversed(removed):
        below = gone.join(labels.withColumnRenamed("v", "p"), "p", "left").select(F.col("u").alias("v"), F.coalesce("r", "p").alias("r"))
        labels = stage(labels.union(below), "labels")
    least = labels.groupBy("r").agg(F.min("v").alias("least"))
    heads = least.select(F.col("r").alias("v"), "r")
    members = labels.select("v", "r").union(heads).distinct()
    return members.join(least, "r").select(F.col("v").alias("id"), F.least("least", "r").alias("group_id"))


def hierarchical_components(edges: DataFrame, u: str = "u", v: str = "v", fan: int = 8, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, group_id) by union-find: local forests, merged level by level.

    Links are range-partitioned, at most about `task_edges` to a task, also
    those of a hub; each partition makes the forest of its links. A vertex that is
    no root is done but for its least root's label and leaves the graph; where
    partitions share a vertex, its roots are linked. These links go on to the
    next level, in an eighth of the partitions (`fan`), but never more than
    `task_edges` to a task: if a level then leaves more than nine tenths of its
    links, `contract` does the rest distributed. group_id is the smallest id of the group.

    Null ends and self-links give nothing; no links, no rows.
    """
    spark = edges.sparkSession
    e, done = stage(clean(edges, u, v), "links"), []
    left = e.count()
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-left // task_edges))
    labels = None
    while left:
        last = parts == 1
        tree = stage(local_forest(e.coalesce(1) if last else e.repartitionByRange(parts, "u", "v")), "forest")
        if last:
            labels = tree
            break
        roots = stage(tree.groupBy("v").agg(F.min("r").alias("m"), F.max("r").alias("far"), F.max(F.col("r") == F.col("v")).alias("root")), "roots")
        done.append(roots.filter("not root").select("v", F.col("m").alias("r")))
        shared = roots.filter("m < far").select("v", "m")
        e = stage(clean(tree.join(shared, "v").select(F.col("r").alias("u"), F.col("m").alias("v"))), "links")
        before, left = left, e.count()
        fewer = max(-(-parts // fan), -(-left // task_edges))
        if fewer > 1 and left > 0.9 * before:
            labels = contract(e, task_edges)
            least = labels.groupBy("r").agg(F.min("v").alias("m"))
            labels = labels.join(least, "r").select("v", F.col("m").alias("r"))
            break
        parts = fewer
    if labels is None:
        labels = spark.createDataFrame([], "v bigint, r bigint")
    for level in reversed(done):
        below = level.join(labels.select(F.col("v").alias("r"), F.col("r").alias("top")), "r", "left")
        labels = stage(labels.union(below.select("v", F.coalesce("top", "r").alias("r"))), "labels")
    heads = labels.select(F.col("r").alias("v"), "r")
    return labels.union(heads).distinct().select(F.col("v").alias("id"), F.col("r").alias("group_id"))


def star_links(df: DataFrame, id_col: str, keys: list[str], salts: int = 16) -> DataFrame:
    """Links that join all ids of equal key without pairs: each id to the least id of its key and salt, those to the least of the key.

    A key that a third of all rows share is spread over `salts` tasks. Rows with
    a null id or key give no link.
    """
    d = df.select(F.col(id_col).alias("id"), *keys).dropna().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    near = d.groupBy(*keys, "salt").agg(F.min("id").alias("m"))
    top = near.groupBy(*keys).agg(F.min("m").alias("t"))
    low = d.join(near, [*keys, "salt"]).select(F.col("m").alias("u"), F.col("id").alias("v"))
    high = near.join(top, keys).select(F.col("t").alias("u"), F.col("m").alias("v"))
    return low.union(high).filter("u <> v")
