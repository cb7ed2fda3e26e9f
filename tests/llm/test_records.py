import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.llm import crosssplit, mixing, pieces, queries
from tests.llm import brute


def got(df):
    return {tuple(r) for r in df.collect()}


def test_found_against_brute_force(spark, data):
    assert got(queries.p2_found(spark, data)) == brute.cross_split(data)
    assert got(queries.p6_found(spark, data)) == brute.oversized(data)


# ---- cross-split overlaps


def test_crowded_words_are_salted(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    want = brute.cross_split(d)
    monkeypatch.setattr(crosssplit, "HOT_WORD", 1)
    assert want and got(queries.p2_found(spark, d)) == want


def square(x, y, w):
    return f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + w}, {x} {y + w}, {x} {y}))"


def line(l, t, r, b, cls="AO"):
    return f"{l} {b} {r} {b} {r} {t} {l} {t} {cls} 1"


def test_pairs_at_the_limits(spark):
    a = "\n".join([line(0, 0, 10, 10), line(31, 31, 60, 60), line(100, 100, 120, 130), line(200, 0, 230, 30)])
    moved = "\r\n".join([line(8, 0, 10, 18, "ao"), line(33, 28, 60, 60), line(100, 100, 120, 130), line(200, 9, 230, 30)])
    far = "\n".join([line(9, 0, 10, 10), line(31, 31, 60, 60), line(100, 100, 120, 130), line(200, 9, 230, 30)])
    rows = [
        (1, square(-20, -30, 100), a, "val"), (2, square(-20, -30, 100), moved, " TRAIN "), (3, square(-20, -30, 100), far, "train"),
        (4, square(-20, -9, 100), a, "train"), (5, square(-20, -19.9, 100), a, "train"), (6, square(-20, -30, 100), a, "test"), (7, square(-20, -30, 100), a, None),
        (8, None, a, "train"), (9, square(-20, -30, 100), None, "train"), (10, square(-20, -30, 100), "", "train"), (2, square(-20, -30, 100), moved, " TRAIN "), (11, square(-20, -30, 100), a, "Train"), (12, square(-20, -30, 0), a, "train"), (None, square(-20, -30, 100), a, "train"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "patch_id long, geometry string, labeltxt string, split_name string, sig string")
    assert got(crosssplit.cross_split_pairs(df)) == {(e, t) for e in (1, 6) for t in (2, 5, 11)}
    assert crosssplit.cross_split_pairs(df.limit(0)).count() == 0


def test_pairs_of_many_sizes(spark):
    rng = np.random.default_rng(7)
    rows, boxes = [], {}
    for i in range(300):
        w, x, y = float(rng.choice([60, 64, 70, 128, 130])), float(rng.integers(-30, 30)), float(rng.integers(-30, 30))
        o = [(int(v[0]), int(v[1]), int(v[0] + v[2]), int(v[1] + v[3])) for v in rng.integers(0, 12, (3, 4))]
        s = ["train", "test", "val"][i % 3]
        rows.append((i, square(x, y, w), "\n".join(line(*b) for b in o), s))
        boxes[i] = (s == "train", (x, y, x + w, y + w), [("ao", *map(float, b)) for b in o])
    want = set()
    for a, (ta, ea, oa) in boxes.items():
        for b, (tb, eb, ob) in boxes.items():
            if not ta and tb and brute.area_shared(ea, eb):
                i = (min(ea[2], eb[2]) - max(ea[0], eb[0])) * (min(ea[3], eb[3]) - max(ea[1], eb[1]))
                if i / ((ea[2] - ea[0]) ** 2 + (eb[2] - eb[0]) ** 2 - i) >= 0.8:
                    m = [[all(abs(p[k] - q[k]) <= 8 for k in range(1, 5)) for q in ob] for p in oa]
                    if sum(map(any, m)) >= 2.25 and sum(map(any, zip(*m, strict=True))) >= 2.25:
                        want.add((a, b))
    df = spark.createDataFrame(rows, "patch_id long, geometry string, labeltxt string, split_name string")
    assert want and got(crosssplit.cross_split_pairs(df)) == want


# ---- pieces


def test_pieces_cover_and_stay_within(spark):
    rng = np.random.default_rng(8)
    items = [("g", i, float(w), float(h)) for i, (w, h) in enumerate(rng.integers(100, 5000, (25, 2)))] + [("g", 100, 512.0, 512.0), ("g", 101, 513.0, 10.0), ("h", 100, 512.5, 1.0), ("g", 102, None, 900.0)]
    objs = [("g", int(i), float(x), float(y), float(x + w), float(y + h)) for i, x, y, w, h in rng.integers(0, [25, 5000, 5000, 90, 90], (900, 5))]
    di = spark.createDataFrame([*items, items[0]], "kind string, id long, width double, height double")
    do = spark.createDataFrame(objs, "kind string, id long, l double, t double, r double, b double")
    out = pieces.cut_items(di, do).collect()
    keys = {(k, i) for k, i, w, h in items if w is not None and max(w, h) > 512}
    assert {(r.kind, r.id) for r in out} == keys
    size = {(k, i): (w, h) for k, i, w, h in items}
    axes = {}
    for r in out:
        assert r.x1 - r.x0 <= 512 and r.y1 - r.y0 <= 512
        axes.setdefault((r.kind, r.id), ({}, {}))[0][r.piece_x] = (r.x0, r.x1)
        axes[r.kind, r.id][1][r.piece_y] = (r.y0, r.y1)
    for key, (xs, ys) in axes.items():
        for cuts, whole in ((xs, size[key][0]), (ys, size[key][1])):
            seq = [cuts[k] for k in sorted(cuts)]
            assert seq[0][0] == 0 and seq[-1][1] == whole and all(b[0] == a[1] - 64 for a, b in zip(seq, seq[1:], strict=False))
    natural = [r for r in out if r.natural]
    assert natural
    for r in natural:
        for k, i, lo, to, hi, bo in objs:
            if (k, i) == (r.kind, r.id):
                assert not (r.x1 < size[k, i][0] and lo < r.x1 < hi) and not (r.y1 < size[k, i][1] and to < r.y1 < bo)
    assert pieces.cut_items(di.limit(0), do).count() == 0 and pieces.cut_items(di, do.limit(0)).filter("not natural").count() == 0
    with pytest.raises(ValueError, match="limit"):
        pieces.cut_items(di, do, limit=100, overlap=64)


def fewest_through_spans(length, spans, limit=512, overlap=64):
    """Least number of cuts through spans, by trying all places from the left."""
    free = [not any(a < x < b for a, b in spans) for x in range(int(length) + limit)]
    best = {overlap: 0}
    for at in range(overlap, int(length) + 1):
        if at in best:
            if at + limit - overlap >= length:
                continue
            for to in range(at + 1, at + limit - overlap + 1):
                best[to] = min(best.get(to, 10**9), best[at] + (not free[to]))
    return min(n for at, n in best.items() if at + limit - overlap >= length)


@pytest.mark.parametrize("range_px", [pieces.RANGE_PX, 700])
def test_no_cut_goes_through_an_object_needlessly(spark, range_px):
    rng = np.random.default_rng(19)
    items = [("g", i, float(w), 100.0) for i, w in enumerate([513, 700, 700.5, 1400, 2600, 5000, 900, 3000])]
    objs = [("g", 1, 150.0, 0.0, 400.0, 9.0), *[("g", 6, 40.0 * k, 0.0, 40.0 * k + 39.5, 9.0) for k in range(23)], ("g", 7, -50.0, 0.0, 2990.0, 9.0)]
    objs += [("g", int(i), float(a), 0.0, float(a + w), 9.0) for i, a, w in zip(rng.choice([2, 3, 4, 5], 200), rng.uniform(-20, 5000, 200), rng.uniform(0, 500, 200) ** 1.2 / 9, strict=True)]
    out = pieces.cut_items(spark.createDataFrame(items, "kind string, id long, width double, height double"), spark.createDataFrame(objs, "kind string, id long, l double, t double, r double, b double"), range_px=range_px).collect()
    for _, i, width, _ in items:
        seq = sorted((r for r in out if r.id == i), key=lambda r: r.piece_x)
        assert [r.piece_x for r in seq] == list(range(1, len(seq) + 1)) and seq[0].x0 == 0 and seq[-1].x1 == width
        assert all(r.x1 - r.x0 <= 512 for r in seq) and all(b.x0 == a.x1 - 64 for a, b in zip(seq, seq[1:], strict=False))
        assert sum(not r.natural for r in seq) == fewest_through_spans(width, [(o[2], o[4]) for o in objs if o[1] == i])
    assert [(r.x0, r.x1) for r in sorted((r for r in out if r.id == 1), key=lambda r: r.piece_x)] == [(0, 512), (448, 700)]


def test_giant_files_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(["word ", "é. ", "line\n", "\n\n", "x" * 90, "日本", "end? "], 3000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("y" * 5000)
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.txt").write_text("short")
    (tmp_path / "e.txt").write_text("日" * 4000, encoding="utf-8")
    paths = [str(tmp_path / f"{n}.txt") for n in "abcde"]
    whole = {tuple(r) for r in pieces.cut_files(spark, paths, 1000, 50, 200).collect()}
    out = pieces.cut_files(spark, paths, 1000, 50, 200, range_bytes=1700).collect()
    assert {tuple(r) for r in out} == whole  # ranges don't show
    raw = {p: open(p, "rb").read() for p in {r.path for r in out}}
    assert len(raw) == 5
    for path, body in raw.items():
        seq = sorted((r for r in out if r.path == path), key=lambda r: r.piece)
        assert [r.piece for r in seq] == list(range(1, len(seq) + 1)) and seq[0].start == 0 and seq[-1].stop == len(body)
        for r in seq:
            assert r.stop - r.start <= 1000 and body[r.start:r.stop].decode() == r.text
        assert all(0 <= a.stop - b.start <= 50 and a.stop - b.start > 46 for a, b in zip(seq, seq[1:], strict=False))
        for r in seq[:-1]:  # a worse boundary is taken only where the window has no better
            late = body[max(r.start, r.stop - 1):r.start + 1000]
            if r.boundary in ("word", "sentence"):
                assert b"\n" not in late[1:]
    assert any(r.boundary == "none" for r in out) and any(r.boundary == "paragraph" for r in out)
    assert sum(r.path.endswith("c.txt") for r in out) == 1 == sum(r.path.endswith("d.txt") for r in out)
    with pytest.raises(ValueError, match="limit"):
        pieces.cut_files(spark, paths, 100, 60, 20)


# ---- mixing


def test_mixture(spark):
    rng = np.random.default_rng(10)
    rows = [(i, ["big", "Mid size ", "small_one", None, "unknown"][min(4, int(v))], "word " * int(n)) for i, (v, n) in enumerate(zip(rng.choice([0, 0, 0, 0, 0, 1, 1, 2, 3, 4], 4000), rng.integers(1, 60, 4000), strict=True))]
    docs = spark.createDataFrame([*rows, (90000, "big", None), (90001, "big", ""), rows[0], (None, "big", "a b")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid_size", 0.3, 2), ("small_one", 0.2, 3), ("absent", 0.1, 3), (None, 0.1, 3)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(docs).cache()
    mix = mixing.mixture(sizes, targets).cache()
    assert mix.count() == mix.select("doc_id", "copy_no").distinct().count() == mix.select("position").distinct().count()
    shares = {r.source: r for r in mixing.actual_shares(mix, sizes, targets).collect()}
    assert set(shares) == {"big", "mid_size", "small_one", "absent"} and shares["absent"].tokens == 0
    for s, want in (("big", 0.5), ("mid_size", 0.3), ("small_one", 0.2)):
        assert shares[s].actual_share == pytest.approx(want, abs=0.01) and shares[s].most_repeats <= shares[s].max_repeats
    assert got(mixing.mixture(sizes, targets)) == got(mix)
    large = mixing.mixture(sizes, targets, total_tokens=1e9)
    assert all(r["m"] == {"big": 1, "mid_size": 2, "small_one": 3}[r.source] for r in large.groupBy("source").agg(F.min("copy_no").alias("n"), F.max("copy_no").alias("m")).collect())
    assert mixing.mixture(sizes, targets.limit(0)).count() == 0 and mixing.mixture(sizes.limit(0), targets).count() == 0


def test_rates():
    for mean, cap in ((0.2, 1), (0.9, 1), (1.5, 2), (2.9, 3), (0.01, 6), (1000.0, 2000), (1999.0, 2000), (30.0, 1_000_000)):
        assert (1 - mixing._cdf(mixing.rate_for(mean, cap), cap)).sum() == pytest.approx(mean, rel=1e-6)
    assert mixing.rate_for(2, 2) == float("inf")
    assert mixing._cdf(3.0, 4).tolist() == pytest.approx([0.0497871, 0.1991483, 0.4231901, 0.6472319])


def test_large_caps_keep_the_shares(spark):
    sizes = spark.range(3000).selectExpr("id as doc_id", "if(id < 20, 'few', 'many') as source", "10 + id % 7 as n_tokens")
    targets = spark.createDataFrame([("few", 0.5, 2000), ("many", 0.5, 7)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(sizes, targets, shuffled=False)
    shares = {r.source: r for r in mixing.actual_shares(mix, sizes, targets).collect()}
    assert shares["few"].actual_share == pytest.approx(0.5, abs=1e-3) and 900 < shares["few"].most_repeats < 2000


def test_counts_are_the_inverted_distribution(spark):
    """Each page's count from its own hash, by plain sums of the Poisson distribution."""
    import math

    sizes = spark.createDataFrame([(i, "ab"[i % 2], 1 + i * 7 % 40) for i in range(800)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.plan(sizes, targets, 20_000.0)
    rate, cap = mixing.rates(sizes, rows, 5), {"a": 3, "b": 2}
    want = {}
    for r in sizes.withColumn("u", mixing.uniform(5)).collect():
        n, below, p = 0, 0.0, math.exp(-rate[r.source])
        while n < cap[r.source] and r.u > (below := below + p):
            n += 1
            p *= rate[r.source] / n
        if n:
            want[r.doc_id] = n
    mix = mixing.mixture(sizes, targets, 20_000.0, 5)
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == want
    tokens = {r.source: r.t for r in mix.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert abs(tokens["a"] - 14_000) <= 45 and abs(tokens["b"] - 6_000) <= 45  # a page's tokens


def test_shares_at_scale(spark):
    """Within half a percent of all tokens on ten thousand pages."""
    for r in queries.p8_shares(spark, "/root/testdata/sf0.1").collect():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.005) and r.most_repeats <= r.max_repeats


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello, world!  Two  blanks\n", "Müller 123's", "", None, "<|endoftext|>"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    want = [0 if x is None else len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert [r[0] for r in df.select(mixing.count_tokens(F.col("t"))).collect()] == want


def test_mixture_comes_out_shuffled(spark):
    sizes = spark.range(3000).selectExpr("id as doc_id", "'a' as source", "10 as n_tokens")
    mix = mixing.mixture(sizes, spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int"))
    rows = mix.collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and len({(r.doc_id, r.copy_no) for r in rows}) == len(rows) > 3000
    assert sum(a.doc_id == b.doc_id for a, b in zip(rows, rows[1:], strict=False)) < 30  # copies of a page don't stand together
