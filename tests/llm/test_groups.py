import numpy as np
import pandas as pd
import pytest

from terraframe.llm import components, grouping, overlap, queries
from tests.llm import brute


def got(df):
    return {tuple(r) for r in df.collect()}


def groups_of(links, ids=()):
    g = brute.Groups()
    for i in ids:
        g.find(i)
    for a, b in links:
        if a is not None and b is not None and a != b:
            g.join(a, b)
    return {(k, g.find(k)) for k in list(g.up)}


def shapes():
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    shuffled = [(int(a) + 5000, int(b) + 5000) for p in [rng.permutation(300)] for a, b in zip(p[:-1], p[1:], strict=True)]
    cycle = [(3000 + i, 3000 + (i + 1) % 60) for i in range(60)]
    star = [(4000, 4001 + i) for i in range(300)]
    dense = [(7000 + int(a), 7000 + int(b)) for a, b in rng.integers(0, 60, (900, 2))]
    sparse = [(9000 + int(a), 9000 + int(b)) for a, b in rng.integers(0, 900, (700, 2))]
    return [*chain, *shuffled, *cycle, *star, *dense, *sparse, (1, 1), (None, 5), (6, None), (8, 7), (7, 8), (7, 8)]


@pytest.mark.parametrize("solve", [
    lambda e: components.strip_components(e, "a", "b"),
    lambda e: components.strip_components(e, "a", "b", task_edges=20),
    lambda e: components.hierarchical_components(e, "a", "b"),
    lambda e: components.hierarchical_components(e, "a", "b", fan=2, task_edges=20),
])
def test_components(spark, solve):
    links = shapes()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in links], "a long, b long, v string, u int")
    want = groups_of(links)
    out = solve(df).collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want
    assert solve(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_stripping_in_one_task(seed):
    rng = np.random.default_rng(seed)
    links = [(a, b) for a, b in shapes() if a is not None and b is not None] + [(20_000 + int(a), 20_000 + int(b)) for a, b in rng.integers(0, 50 * 4**seed, (400, 2))]
    u, v = np.array(links).T
    assert set(zip(*(x.tolist() for x in components.strip_in_task(u, v)), strict=True)) == groups_of(links) | {(k, k) for a, b in links if a == b for k in [a] if k not in dict(groups_of(links))}
    assert len(components.strip_in_task(u[:0], v[:0])[0]) == 0


def test_chains_are_ranked_to_their_ends(spark):
    line, ring = [(i, i + 1) for i in range(10)], [(100 + i, 100 + (i + 1) % 7) for i in range(7)]
    ends = components._ends(components.clean(spark.createDataFrame([*line, *ring, (0, 50), (0, 51)], "u long, v long")))
    assert got(components.rank_chains(ends.filter("deg = 2").select("u", "n1", "n2"))) == {(i, 0, 10) for i in range(1, 10)}


def test_no_task_merges_more_than_its_bound(spark, monkeypatch):
    rng = np.random.default_rng(5)
    links = rng.integers(0, 200_000, (300_000, 2))
    links[:100_000, 0] = 7  # a hub with a third of all links
    df = spark.createDataFrame(pd.DataFrame(links, columns=["a", "b"])).repartition(8).cache()
    largest, local = [], components.local_forest
    monkeypatch.setattr(components, "local_forest", lambda e: (largest.append(max(e.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())), local(e))[1])
    out = components.hierarchical_components(df, "a", "b", task_edges=20_000).toPandas()
    want = dict(groups_of(links.tolist()))
    assert dict(zip(out["id"], out["group_id"], strict=True)) == want
    assert max(largest) <= 1.5 * 20_000  # range bounds are sampled
    largest.clear()
    assert components.contract(spark.createDataFrame([(i, i + 1) for i in range(3000)], "u long, v long"), 300).select("r").distinct().count() == 1
    assert max(largest) <= 300
    at = rng.permutation(6000)  # a ring in random order hardly shrinks within partitions
    ring = spark.createDataFrame(pd.DataFrame({"a": at, "b": np.roll(at, 1)}))
    assert components.hierarchical_components(ring, "a", "b", task_edges=300).filter("group_id = 0").count() == 6000
    assert max(largest) <= 1.5 * 300


def test_stars(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (None, "a"), *[(10 + i, "a") for i in range(100)]], "id long, k string")
    e = got(components.star_links(df, "id", ["k"]))
    assert groups_of(e) == {(i, 1) for i in (1, 2, *range(10, 110))} and len(e) <= 130


def boxes(n, seed, spread):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, spread, (n, 4))
    w = rng.integers(0, 9, (n, 2))
    return [(i, "ab"[i % 2], float(x), float(y), float(x + a), float(y + b)) for i, ((x, y, _, _), (a, b)) in enumerate(zip(v.tolist(), w.tolist(), strict=True))]


@pytest.mark.parametrize(("rows", "hot"), [
    (boxes(300, 1, 120), 2000),
    (boxes(300, 2, 60), 5),
    # a stack of boxes a little apart, many equal ones, and large boxes over small ones
    ([(i, "a", i * 0.5, 0.0, i * 0.5 + 40, 40.0) for i in range(60)] + [(100 + i, "a", 500.0, 500.0, 501.0, 501.0) for i in range(50)] + [(200, "b", -900.0, -900.0, 900.0, 900.0), (201, "b", 1.0, 1.0, 1.5, 1.5), (202, "b", 900.0, 900.0, 901.0, 901.0)], 4),
])
def test_overlap_links(spark, rows, hot):
    df = spark.createDataFrame([*rows, (9001, None, 0.0, 0.0, 9.0, 9.0), (9002, "a", None, 0.0, 9.0, 9.0), (None, "a", 0.0, 0.0, 9.0, 9.0), (9003, "a", 0.0, 0.0, 0.0, 9.0)], "box long, id string, minx double, miny double, maxx double, maxy double")
    links = got(overlap.overlap_links(df, "box", ["id"], hot_cell=hot))
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and brute.area_shared(a[2:], b[2:])]
    assert groups_of(links) == groups_of(want)
    assert overlap.overlap_links(df.limit(0), "box", ["id"]).count() == 0


def test_found_against_brute_force(spark, data):
    assert got(queries.p4_found(spark, data)) == brute.patch_groups(data)
    assert got(queries.p5_found(spark, data)) == brute.detection_groups(data)


def test_raster_names(spark):
    paths = ["a/b/1_2__KLN-1__b__images.tif", "D:\\a\\1_2__kln-1__B__images.TIF ", "a%2Fb%2F1%5F2%5F%5FKLN-1%5F%5Fb%5F%5Fx.txt", "a/1_2__.tif", "", None, "a/1__x%zz__y.tif"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(grouping.raster_of_path(df.p)).collect()] == ["kln-1__b"] * 3 + [None] * 3 + ["x%zz"]


def test_patches_with_gaps(spark):
    box = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    rows = [(1, None, None, None, 9), (2, box, None, "x/1__R__k.txt", 9), (3, None, "x/2__r__k.tif", None, 9), (3, None, "x/2__r__k.tif", None, 9), (None, box, None, None, 9), (4, "POLYGON EMPTY", "", "", 9), (5, "POLYGON ((1 0, 2 0, 2 1, 1 0))", None, None, 9)]
    df = spark.createDataFrame(rows, "patch_id long, geometry string, images_path string, labeltxt_path string, group_id int")
    assert got(grouping.related_patches(df)) == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 5)}
    assert grouping.related_patches(df.limit(0)).count() == 0


def greedy(sizes, shares):
    total = sum(sizes)
    short = {k: v * total for k, v in shares.items()}
    for s in sorted(sizes, reverse=True):
        k = max(short, key=lambda n: short[n])
        short[k] -= s
    return {k: round(shares[k] * total - v) for k, v in short.items()}


def test_greedy_in_bulk():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.concatenate([rng.integers(1, 6, 200), rng.integers(1, 300, 5)]).tolist()
        counts = {s: sizes.count(s) for s in set(sizes)}
        plan = grouping.quotas(list(counts.items()), grouping.SPLITS)
        assert sum(hi - lo for _, _, lo, hi in plan) == len(sizes)
        got_ = {k: sum(s * (hi - lo) for s, n, lo, hi in plan if n == k) for k in grouping.SPLITS}
        assert all(abs(got_[k] - v) <= 5 for k, v in greedy(sizes, grouping.SPLITS).items())


def test_no_group_is_torn(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(g)) for i, g in enumerate(rng.integers(0, 400, 3000))] + [(5000, None)]
    df = spark.createDataFrame(rows, "size long, part long")
    out = grouping.assign_splits(df, "size", "part").collect()
    assert len(out) == 3000
    of = {}
    for r in out:
        of.setdefault(r["part"], set()).add(r["split"])
    assert all(len(v) == 1 for v in of.values())
    n = {k: sum(r["split"] == k for r in out) for k in grouping.SPLITS}
    assert all(abs(n[k] / 3000 - v) < 0.01 for k, v in grouping.SPLITS.items())
    assert grouping.assign_splits(df.limit(0), "size", "part").count() == 0


def test_tops(spark, data):
    out = queries.p5_groups(spark, data).collect()
    assert sum(r.n_detections for r in out) == len(brute.detection_groups(data)) and all(r.top_score > 0.5 for r in out)


def test_detections_with_gaps(spark):
    box = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    rows = [(1, box, 0.9, "AO"), (2, box, 0.6, " ao "), (3, box, 0.5, "AO"), (4, box, float("nan"), "AO"), (5, box, None, "AO"), (6, box, 0.9, None), (7, None, 0.9, "AO"), (8, box, 0.9, "barrow"), (1, box, 0.9, "AO"), (None, box, 0.9, "AO")]
    df = spark.createDataFrame(rows, "det_id long, geometry string, score double, label string")
    assert got(grouping.overlapping_detections(df)) == {(1, 1), (2, 1)}
    assert grouping.overlapping_detections(df.limit(0)).count() == 0
