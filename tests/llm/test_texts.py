import numpy as np
import pytest

from terraframe.llm import leakage, queries, spans
from tests.llm import brute


def got(df):
    return {tuple(r) for r in df.collect()}


# ---- shared spans


def test_spans_against_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] for r in brute.rows(data, "documents", ["doc_id", "text"])}
    assert got(queries.p9_found(spark, data)) == brute.shared_stretches(texts)


@pytest.mark.parametrize("alphabet", ["ab \n.", "abcdefghijklmnopqrstuvwxyz", "aé日𝄞. \n"])
def test_spans_of_odd_texts(spark, alphabet):
    rng = np.random.default_rng(len(alphabet))
    rand = lambda n: "".join(rng.choice(list(alphabet), n))
    core = [rand(n) for n in (399, 400, 401, 450, 700, 1500)]
    texts = {}
    for i in range(60):
        a, b = core[i % 6], core[int(rng.integers(6))]
        cut = int(rng.integers(0, len(b) // 3))
        texts[i] = rand(int(rng.integers(0, 300))) + a + rand(int(rng.integers(0, 90))) + b[cut:] + rand(int(rng.integers(0, 300)))
    texts |= {100: core[4], 101: core[4], 102: core[5][:900] + core[5][300:], 103: "", 104: "x" * 399, 105: "x" * 900, 106: "x" * 401, 107: rand(5000), 108: None}
    rows = [(k, v, 1) for k, v in texts.items()] + [(107, texts[107], 1), (None, core[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int")
    assert got(spans.shared_spans(df)) == brute.shared_stretches(texts)


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, "a" * 800)], "doc_id long, text string")
    assert spans.shared_spans(df).count() == 0 and spans.shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="span"):
        spans.shared_spans(df, 200)


def test_unit_bounds_are_local():
    rng = np.random.default_rng(5)
    mid = "".join(rng.choice(list("abc d.\n"), 800, p=[0.3, 0.3, 0.2, 0.12, 0.04, 0.02, 0.02]))
    found = []
    for _ in range(20):
        head, tail = ("".join(rng.choice(list("abc d.\n"), int(rng.integers(0, 200)))) for _ in range(2))
        codes = spans._codes(head + mid + tail)
        h = spans.Hashes(codes, spans._M1)
        g = np.arange(len(codes) - spans.GRAM + 1)
        at = spans.breaks(codes, h.of(g, g + spans.GRAM)) - len(head)
        inside = at[(at >= spans.MARGIN) & (at <= 800 - spans.MARGIN)]
        assert np.diff(inside).max() <= 4 * spans.W
        found.append(tuple(inside))
    assert len(set(found)) == 1


# ---- leaked passages

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("r", "st", "m", "ndo", "lik")]


def passage(rng, n):
    return [str(w) for w in rng.choice(WORDS, n)]


def page(lines, columns=1, per=8, merged=False, across=False):
    """Text and boxes of a page whose lines run down the columns."""
    boxed = [(60 + 480 * (i // per), 100 + 30 * (i % per), s) for i, s in enumerate(lines)]
    if merged:
        left, right = boxed[:per], boxed[per: 2 * per]
        boxed = [(a[0], a[1], a[2] + ("   " + right[k][2] if k < len(right) else "")) for k, a in enumerate(left)]
    elif across:
        boxed.sort(key=lambda b: (b[1], b[0]))
    return "\n".join(b[2] for b in boxed), [{"x0": b[0], "y0": b[1], "x1": b[0] + 10 * len(b[2]), "y1": b[1] + 25, "conf": 0.9} for b in boxed]


def wrap(words, width=6):
    return [" ".join(words[i: i + width]) for i in range(0, len(words), width)]


SCHEMA = "doc_id long, text string, line_boxes array<struct<x0: int, y0: int, x1: int, y1: int, conf: float>>"


def test_leaks(spark):
    rng = np.random.default_rng(11)
    items = [(i, passage(rng, 40)) for i in range(1, 9)]
    ws = dict(items)
    noise = lambda n: passage(rng, n)
    wrong = lambda words, *at: [w + "zq" if i in at else w for i, w in enumerate(words)]
    docs, want = [], set()

    def add(doc, lines, hit=(), **kw):
        docs.append((doc, *page(lines, **kw)))
        want.update((doc, i) for i in hit)

    add(1, wrap(noise(30) + ws[1] + noise(30)), [1], per=40)
    add(2, wrap(noise(20) + ws[2][10:30] + noise(30)), [2], per=40)
    add(3, wrap(noise(20) + ws[2][10:29] + noise(30)), per=40)
    add(4, wrap(noise(31) + ws[3] + noise(20)), [3], per=8, columns=2, across=True)
    add(5, wrap(noise(31) + ws[4] + noise(20)), [4], per=8, columns=2, merged=True)
    add(6, wrap(noise(20) + wrong(ws[5][:24], 4, 9, 14, 19) + noise(20)), [5], per=40)
    add(7, wrap(noise(20) + wrong(ws[5][:22], 3, 7, 11, 15, 19) + noise(20)), per=40)
    add(8, wrap([w.upper() + "," for w in ws[6]]), [6], per=40)
    add(9, wrap(ws[7] + noise(3) + ws[8]), [7, 8], per=40)
    add(10, wrap(ws[1][:10] + noise(10) + ws[1][10:19]), per=40)
    broken = wrap(ws[3])
    for k, mark in enumerate("-=¬\u00ad"):
        head, tail = broken[k][:-2], broken[k][-2:]
        broken[k], broken[k + 1] = head + mark, tail + " " + broken[k + 1]
    add(11, broken, [3], per=40)
    text, boxes = page(wrap(ws[4]), per=40)
    lines = text.split("\n")
    lines[3:3] = ["LOST, near", "here. REWARD"]
    boxes = [{**boxes[0], "y0": 100 + 30 * i, "x0": 95 if i in (3, 4) else 60} for i in range(len(lines))]
    docs.append((12, "\n".join(lines), boxes))
    want.add((12, 4))
    docs += [(13, "", []), (14, None, None), (None, text, boxes), (15, " ".join(ws[5]), None), (16, "\n".join(wrap(ws[6])), []), docs[0]]
    want |= {(15, 5), (16, 6)}
    split = wrap(ws[7])
    split[1] = split[1][:3] + " " + split[1][3:]
    docs.append((17, *page(split, per=40)))
    want.add((17, 7))
    df = spark.createDataFrame(docs, SCHEMA)
    found = asked(spark, [(i, " ".join(w)) for i, w in items] + [(90, "too short to leak"), (91, None), (None, "no id"), (1, " ".join(ws[1]))])
    assert got(leakage.leaks(df, found)) == want
    assert got(leakage.leaks(df, found, slice_chars=500)) == want  # several readings of the pages
    assert got(leakage.leaks(df.limit(0), found)) == set() and got(leakage.leaks(df, found.limit(0))) == set()


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, passage string")


def holds(item, tokens):
    """Whether 20 words or more in a row stand in the tokens, word by word or parted in two, at most one in six misread."""
    def walk(i, j, run, bad):
        if run >= 20 and bad * 6 <= run:
            return True
        if i == len(item) or j >= len(tokens) or bad * 6 > len(item):
            return False
        if item[i] == tokens[j]:
            if walk(i + 1, j + 1, run + 1, bad):
                return True
        elif j + 1 < len(tokens) and item[i] == tokens[j] + tokens[j + 1]:
            if walk(i + 1, j + 2, run + 1, bad):
                return True
        elif leakage._alike(item[i], tokens[j]) and walk(i + 1, j + 1, run + 1, bad + 1):
            return True
        return False

    return any(walk(i, j, 0, 0) for i in range(len(item) - 19) for j in range(len(tokens)))


def test_no_leak_is_lost(spark):
    """Against brute force: few different words, misread and parted words, stray fragments of the same passage."""
    rng = np.random.default_rng(31)
    items, docs = [], []
    for i in range(160):
        few = i % 4 == 0
        item = [str(w) for w in rng.choice(WORDS[:6] if few else WORDS, int(rng.integers(20, 40)))]
        lo = int(rng.integers(0, len(item) - 19))
        run = item[lo: lo + int(rng.integers(18, 26))]
        at = rng.permutation(len(run))
        n_bad, n_cut = int(rng.integers(0, 5)), int(rng.integers(0, 7))
        out = []
        for k, w in enumerate(run):
            if k in at[:n_bad]:
                out.append("x" + w[1:])
            elif k in at[n_bad: n_bad + n_cut]:
                out += [w[:2], w[2:]]
            else:
                out.append(w)
        stray = item[lo + 12: lo + 19] if i % 3 == 0 else []
        tokens = passage(rng, 15) + stray + passage(rng, 9) + out + passage(rng, 15)
        items.append((i, " ".join(item)))
        docs.append((i, "\n".join(wrap(tokens)), None))
    want = {(i, i) for (i, text), (_, page_, _) in zip(items, docs, strict=True) if holds(text.split(), page_.split())}
    found = got(leakage.leaks(spark.createDataFrame(docs, SCHEMA), asked(spark, items)))
    assert 40 < len(want) < 150 and want <= found
    assert len({(d, i) for d, i in found if d == i} - want) <= 8  # words left out or put in are borne, too


def test_a_long_advert_is_passed_over(spark):
    rng = np.random.default_rng(32)
    item = passage(rng, 24)
    lines = wrap(passage(rng, 12)) + wrap(item[:12]) + [" ".join(passage(rng, 5)) for _ in range(14)] + wrap(item[12:]) + wrap(passage(rng, 12))
    apart = wrap(passage(rng, 12)) + wrap(item[:12]) + [" ".join([*passage(rng, 3), *item[12:]])]
    df = spark.createDataFrame([(1, "\n".join(lines), None), (2, "\n".join(apart), None)], SCHEMA)
    assert got(leakage.leaks(df, asked(spark, [(7, " ".join(item))]))) == {(1, 7)}


def test_blocks_of_passages(spark, monkeypatch):
    rng = np.random.default_rng(12)
    items = [(i, " ".join(passage(rng, 30))) for i in range(20)]
    df = spark.createDataFrame([(i, t, None) for i, t in items], SCHEMA)
    monkeypatch.setattr(leakage, "VOCABULARY", 100)
    assert got(leakage.leaks(df, asked(spark, items))) == {(i, i) for i, _ in items}


def test_longest_matches_are_found():
    rng = np.random.default_rng(13)
    p = leakage.Passages([(i, [str(w) for w in rng.choice(list("abcdef"), 25)]) for i in range(6)])
    text = rng.integers(0, 7, 900)
    i, at, n = p.matches(text.astype(np.int64))
    got_ = set(zip(i.tolist(), at.tolist(), n.tolist(), strict=True))
    want = set()
    codes = p.codes.tolist()
    t = text.tolist()
    for a in range(len(codes)):
        for b in range(len(t)):
            k = 0
            while a + k < len(codes) and b + k < len(t) and codes[a + k] == t[b + k] > 0:
                k += 1
            if k >= leakage.SEED and not (a and b and codes[a - 1] == t[b - 1] > 0):
                want.add((a, b, k))
    assert got_ == want


def test_suffixes_are_in_order():
    rng = np.random.default_rng(14)
    codes = rng.integers(0, 4, 3000).astype(np.int64)
    codes[500:540] = codes[900:940] = 1
    at, head, rank = leakage.suffix_ranks(codes, 4)
    suffix = [tuple(codes[k: k + int(np.flatnonzero(codes[k:] == 0)[0])].tolist()) if (codes[k:] == 0).any() else tuple(codes[k:].tolist()) for k in at]
    cut = [s[: len(s) - len(s) % leakage.SEED] for s in suffix]  # the last words, fewer than four, stay unordered
    order = np.lexsort((rank, head))
    assert all(s[:4] <= t[:4] for s, t in zip([suffix[k] for k in order], [suffix[k] for k in order[1:]], strict=False))
    longest = {}
    for k, r in enumerate(rank.tolist()):
        longest.setdefault(r, set()).add(cut[k])
    assert all(len(v) == 1 for v in longest.values())


def test_reports(spark, data):
    found = got(queries.p7_found(spark, data))
    assert {r.doc_id: r.n_items for r in queries.p7_report(spark, data).collect()} == {d: sum(x == d for x, _ in found) for d, _ in found}
    kept = {r.doc_id for r in queries.p7_kept(spark, data).collect()}
    assert kept.isdisjoint(d for d, _ in found) and len(kept) == 1000 - len({d for d, _ in found})


def test_very_long_texts(spark):
    rng = np.random.default_rng(21)
    filler = " ".join(passage(rng, 150_000))
    shared = " ".join(passage(rng, 90))
    long = filler + "\n" + shared + "\n" + filler[::-1]
    small = "start " + shared + " end"
    df = spark.createDataFrame([(1, long), (2, small), (3, "x" * 600_000)], "doc_id long, text string")
    n = len(filler)
    assert got(spans.shared_spans(df)) == {(1, n + 1, n + 1 + len(shared)), (2, 6, 6 + len(shared))}
    item = passage(rng, 40)
    page_ = "\n".join(wrap(passage(rng, 90_000) + item + passage(rng, 90_000)))
    docs = spark.createDataFrame([(1, page_, None)], SCHEMA)
    assert got(leakage.leaks(docs, asked(spark, [(5, " ".join(item))]))) == {(1, 5)}


def test_long_stretches_cost_windows_at_their_ends_only(spark, monkeypatch):
    rng = np.random.default_rng(41)
    line = lambda: " ".join(passage(rng, 8))
    shared = "\n".join(line() for _ in range(900))
    texts = {k: "\n".join([*(line() for _ in range(20)), shared[k * 500:], *(line() for _ in range(20))]) for k in range(4)}
    seen, stage = [], spans.stage
    monkeypatch.setattr(spans, "stage", lambda df, name: (out := stage(df, name), seen.append((name, out.count())))[0])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(spans.shared_spans(df)) == brute.shared_stretches(texts)
    assert dict(seen)["windows"] < 0.05 * sum(map(len, texts.values()))


def test_repeated_sentences_are_removed_but_once(spark):
    both = " ".join(f"Shared sentence number {i} of the notice reads so." for i in range(12))
    own = {k: " ".join(f"Text {k} says thing {i * k} by itself here." for i in range(20)) for k in (1, 2, 3)}
    texts = {1: f"{own[1]} {both} End one.", 2: f"{own[2]} {both} End two.", 3: f"Zz. {both} {own[3]}", 4: f"{own[1]} {both} End one.", 5: "short", 6: None}
    out = {r.doc_id: (r.text, r.removed_chars) for r in spans.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert out[1] == (texts[1], 0) and out[5] == ("short", 0) and out[6] == (None, 0)  # the first keeps all
    assert out[2] == (f"{own[2]} End two.", len(both) + 1) and out[3] == (f"Zz. {own[3]}", len(both) + 1)
    assert out[4] == ("", len(texts[4]))  # a whole copy
