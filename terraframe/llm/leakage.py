"""Evaluation passages that stand, wholly or in part, on scanned pages of a corpus."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.plans import stage

LEAST_RUN, ONE_IN = 20, 6
SEED = 4  # words that every qualifying run has verbatim in a row somewhere
VOCABULARY = 30_000  # different words of one block of passages
BLOCK_WORDS = 500_000  # words of one block in all
SLICE_CHARS = 64 << 20  # characters of passages that go to a task with one reading of the corpus
PAGE_END = "\n\n"
# signs of a word broken at a line's end
_BROKEN = re.compile("(?<=[^\\W_])[-=¬­‐]+[ \t]*\n\\s*")
_DROPPED = dict.fromkeys(map(ord, "'’-=¬­‐"))
_TOKEN = re.compile(r"[^\W_]+|\n")
_GAP = re.compile(r" {3,}|\t+")
COLUMN_JITTER, INSET = 15, 60  # px: spread of a column's left edge; how far an advert is set in at most


def words(text: str) -> list[str]:
    """Words of a passage, case and punctuation ignored."""
    return [w for w in _TOKEN.findall(text.casefold().translate(_DROPPED)) if w != "\n"]


def as_printed(text: str, x0: list[int], y0: list[int], x1: list[int]) -> str:
    """Lines of a page down each column, columns from left to right, set-in lines (adverts, rules) left out.

    A line that holds two columns side by side (a wide gap inside) is parted.
    Lines without a box each are taken in the order given.
    """
    lines = text.split("\n")
    if len(lines) != len(x0):
        return text
    lefts: list[list[int]] = []
    for x in sorted(x0):
        if lefts and x - lefts[-1][1] <= COLUMN_JITTER:
            lefts[-1][1] = x
        else:
            lefts.append([x, x])
    columns, inset_from = [], []
    for lo, hi in lefts:
        if columns and lo - columns[-1][1] < INSET:
            inset_from.append((lo, hi))
        else:
            columns.append((lo, hi))
    starts = [lo for lo, _ in columns]
    out = []
    for n, line in enumerate(lines):
        x = x0[n]
        own = bisect_right(starts, x) - 1
        keep = not any(lo <= x <= hi for lo, hi in inset_from)
        if "   " in line or "\t" in line:
            parts = _GAP.split(line.strip())
            at, width = 0, (x1[n] - x) / max(1, len(line))
            for k, part in enumerate(parts):
                place = x + width * at
                col = own + k
                if k and col < len(starts):
                    col = max(col, min(range(len(starts)), key=lambda c: abs(starts[c] - place)))
                if k or keep:
                    out.append((col, y0[n], n, part))
                at += len(part) + 3
        elif keep:
            out.append((own, y0[n], n, line))
    out.sort(key=lambda v: v[:3])
    return "\n".join(v[3] for v in out)


class Passages:
    """A block of passages: their words as numbers, put end to end, a 0 after each."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = items
        self.number = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.starts = np.concatenate([[0], np.cumsum([len(ws) + 1 for _, ws in items])]).astype(np.int64)
        self.codes = np.zeros(int(self.starts[-1]), np.int64)
        for (_, ws), at in zip(items, self.starts, strict=False):
            self.codes[at: at + len(ws)] = [self.number[w] for w in ws]
        known = self.number.get
        self.pairs = np.array([known(w[:k]) * (len(self.number) + 1) + known(w[k:]) for w in self.number for k in range(1, len(w)) if known(w[:k]) and known(w[k:])], np.int64)

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item position, text position and length of each longest verbatim match of SEED words or more.

        The shard's suffixes are ordered in a suffix array (`suffix_ranks`); each
        passage suffix is found in it by binary search, which gives all places
        that share SEED words with it, and each is extended to its full length.
        Hits that continue a match to the left are part of that match and left out.
        """
        m = len(self.codes)
        both = np.concatenate([self.codes, codes, np.zeros(SEED, np.int64)])
        at, head, rank = suffix_ranks(both, len(self.number) + 1)
        own = at < m
        order = np.lexsort((rank[~own], head[~own]))
        sa, key = at[~own][order] - m, head[~own][order]
        lo, hi = np.searchsorted(key, head[own], "left"), np.searchsorted(key, head[own], "right")
        n = hi - lo
        i = np.repeat(at[own], n)
        p = sa[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        left = (i > 0) & (p > 0)
        left[left] = (self.codes[i[left] - 1] == codes[p[left] - 1]) & (self.codes[i[left] - 1] > 0)
        i, p = i[~left], p[~left]
        length = np.full(len(i), SEED)
        open_ = np.arange(len(i))
        while len(open_):
            a, b = i[open_] + length[open_], p[open_] + length[open_]
            ok = (a < m) & (b < len(codes))
            open_, a, b = open_[ok], a[ok], b[ok]
            open_ = open_[(self.codes[a] == codes[b]) & (self.codes[a] > 0)]
            length[open_] += 1
        return i, p, length


def suffix_ranks(codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where SEED words or more begin (codes above 0; a 0 ends a suffix), rank of their first SEED words, rank of the suffix.

    Prefix doubling: the order by the first SEED words is refined to twice as many
    words in a round, as far as the longest suffix goes; of the last words of a
    suffix, fewer than SEED stay unordered. Ranks of equal words are equal.
    """
    known = codes > 0
    at = np.flatnonzero(known[: max(0, len(codes) - SEED + 1)])
    for k in range(1, SEED):
        at = at[known[at + k]]
    if not len(at):
        return at, at, at
    halves = np.unique(np.concatenate([codes[at] * n_codes + codes[at + 1], codes[at + 2] * n_codes + codes[at + 3]]), return_inverse=True)[1]
    head = np.unique(halves[: len(at)] * (int(halves.max()) + 1) + halves[len(at):], return_inverse=True)[1]
    rank, step = head, SEED
    end = np.flatnonzero(~known)
    room = end[np.searchsorted(end, at)] - at  # words up to the suffix's end
    while step < int(room.max()):
        place = np.minimum(np.searchsorted(at, at + step), len(at) - 1)
        next_ = np.where((at[place] == at + step) & (room > step), rank[place] + 1, 0)
        new = np.unique(rank * (int(rank.max()) + 2) + next_, return_inverse=True)[1]
        if int(new.max()) == int(rank.max()) and (new == rank).all():
            break
        rank, step = new, step * 2
    return at, head, rank


def rejoined(tokens: list[str], codes: np.ndarray, number: dict[str, int], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with words that a scan parted put together, and the place of each in the tokens.

    Two words go together if they make a known one: an unknown word with the one
    after it, else with the one before; two known words if they are in `pairs`
    (keys of parts that are words of their own).
    """
    out, at, n, base = codes.copy(), np.ones(len(codes), bool), len(tokens), len(number) + 1
    unknown = np.flatnonzero(codes == 0)
    starts = [unknown, unknown[unknown > 0] - 1]
    if len(pairs):
        starts.append(np.flatnonzero(np.isin(codes[:-1] * base + codes[1:], pairs) & (codes[:-1] > 0)))
    skip = -1
    for k in np.unique(np.concatenate(starts)).tolist():
        if k > skip and k + 1 < n and (w := number.get(tokens[k] + tokens[k + 1])):
            out[k], at[k + 1], skip = w, False, k + 1
    places = np.flatnonzero(at)
    return out[places], places


def _alike(a: str, b: str) -> bool:
    return len(a) > 1 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.5


def _whole_lines(line: np.ndarray, s: int, e: int) -> bool:
    """Whether words s and e close and open a line, so that whole lines lie between them."""
    return bool((e == 0 or line[e] != line[e - 1]) and s + 1 < len(line) and line[s + 1] != line[s])


def _qualifies(good: np.ndarray, lo: int, hi: int) -> bool:
    """Whether LEAST_RUN words or more of good[lo:hi] in a row have at most one in ONE_IN that is not good."""
    bad = np.concatenate([[0], np.cumsum(~good[lo:hi])])
    return any((bad[size:] - bad[: len(bad) - size]).min() * ONE_IN <= size for size in range(hi - lo, LEAST_RUN - 1, -1))


def longest_run(item: list[str], page: list[str], line: np.ndarray) -> bool:
    """Whether LEAST_RUN consecutive words of the item or more stand in the page piece, at most one in ONE_IN misread.

    Words that a scan parted are put together; whole lines between two parts of
    a run (an advert that was not set in) are passed over, up to five here; any
    number in `chained_run`, which decides what this quick look rejects.
    """
    have, text, at = set(item), [], []
    k = 0
    while k < len(page):
        if k + 1 < len(page) and page[k] not in have and page[k] + page[k + 1] in have:
            text.append(page[k] + page[k + 1])
            at.append(k)
            k += 2
        else:
            text.append(page[k])
            at.append(k)
            k += 1
    blocks = [b for b in SequenceMatcher(None, item, text, autojunk=False).get_matching_blocks() if b.size]
    chains: list[list] = []
    for b in blocks:
        if chains:
            q = chains[-1][-1]
            gi, gp = b.a - q.a - q.size, b.b - q.b - q.size
            close = abs(gp - gi) <= 2
            if not close and gp > gi:
                # the lines passed over must be whole: a line starts gi words before the match, one ended after the last
                s, e = at[q.b + q.size - 1], at[max(q.b + q.size, b.b - gi)]
                close = _whole_lines(line, s, e) and line[e] - line[s] <= 6
            if close:
                chains[-1].append(b)
                continue
        chains.append([b])
    for chain in chains:
        lo, hi = chain[0].a, chain[-1].a + chain[-1].size
        good = np.zeros(len(item), bool)
        for b in chain:
            good[b.a: b.a + b.size] = True
        p = chain[0].b
        while lo and p and _alike(item[lo - 1], text[p - 1]):
            lo, p = lo - 1, p - 1
        p = chain[-1].b + chain[-1].size
        while hi < len(item) and p < len(text) and _alike(item[hi], text[p]):
            hi, p = hi + 1, p + 1
        if _qualifies(good, lo, hi):
            return True
    return False


def chained_run(item: list[str], page: list[str], line: np.ndarray) -> bool:
    """The same as `longest_run` by chaining, first word for word, then with up to two words more or less between matches."""
    return any(_chained(item, page, line, slip) for slip in (0, 2))


def _chained(item: list[str], page: list[str], line: np.ndarray, slip: int) -> bool:
    """Whether a run stands on the page, by chaining every matching word, so that no stray match can hide a run.

    Matches are equal words, and item words parted in two on the page, whether
    or not the parts are words of their own. Each match goes on from the match
    before it that gives the most: next to it but for misread words (as many on
    both sides, up to `slip` more or less), or behind any number of whole lines.
    """
    places: dict[str, list[int]] = {}
    for k, w in enumerate(item):
        places.setdefault(w, []).append(k)
    ends: list[dict[int, list[tuple[int, int]]]] = [{} for _ in item]  # per item word, by its last place on the page: matches
    at: list[tuple[int, int, int]] = []
    for j, w in enumerate(page):
        at += [(i, j, 1) for i in places.get(w, ())]
        if j + 1 < len(page):
            at += [(i, j, 2) for i in places.get(w + page[j + 1], ())]
    gain, back = [0] * len(at), [-1] * len(at)
    starts = (np.flatnonzero(np.diff(line)) + 1).tolist()
    opens, closes = {0, *starts}, {j - 1 for j in starts}
    order = sorted(range(len(at)), key=lambda m: (at[m][0], at[m][1]))
    most = max(3, len(item) // ONE_IN)
    closing: list[list[tuple[int, int]]] = [[] for _ in item]  # matches that end a line, by their item word
    for m in order:
        i, j, n = at[m]
        best, source = None, -1
        for gi in range(min(most, i) + 1):
            if i - 1 - gi < 0 or not (ended := ends[i - 1 - gi]):
                continue
            for gp in range(max(0, gi - slip), gi + slip + 1):
                for q, g in ended.get(j - 1 - gp, ()):
                    if best is None or g - (ONE_IN - 1) * gi > best:
                        best, source = g - (ONE_IN - 1) * gi, q
        for gi in range(min(most, i, j) + 1):
            if j - gi in opens and i - 1 - gi >= 0:
                for cj, q in closing[i - 1 - gi]:
                    if cj < j - gi and (best is None or gain[q] - (ONE_IN - 1) * gi > best):
                        best, source = gain[q] - (ONE_IN - 1) * gi, q
        gain[m] = 1 + max(best, -4 * ONE_IN) if best is not None else 1
        back[m] = source
        last = j + n - 1
        ends[i].setdefault(last, []).append((m, gain[m]))
        if last in closes:
            closing[i].append((last, m))
    for m in sorted(range(len(at)), key=lambda m: -gain[m]):
        good, k, first = np.zeros(len(item), bool), m, m
        while k >= 0:
            good[at[k][0]], first, k = True, k, back[k]
        lo, hi, p = at[first][0], at[m][0] + 1, at[first][1]
        if hi - lo + 2 * most < LEAST_RUN or gain[m] < 1 - 4 * ONE_IN:
            continue
        while lo and p and _alike(item[lo - 1], page[p - 1]):
            lo, p = lo - 1, p - 1
        p = at[m][1] + at[m][2]
        while hi < len(item) and p < len(page) and _alike(item[hi], page[p]):
            hi, p = hi + 1, p + 1
        if hi - lo >= LEAST_RUN and _qualifies(good, lo, hi):
            return True
    return False


def enough(have: set[str], page: list[str]) -> bool:
    """Whether the page piece has as many words of the item, whole or parted, as any qualifying run has verbatim."""
    n = sum(w in have for w in page)
    least = LEAST_RUN - LEAST_RUN // ONE_IN
    return n >= least or n + sum(a + b in have for a, b in zip(page, page[1:], strict=False)) >= least


def leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", passage: str = "passage", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id) of each page that holds at least 20 consecutive words of a passage as printed.

    docs: doc_id, text, line_boxes. The page is put in reading order, broken
    words are rejoined, set-in adverts left out, case and punctuation ignored;
    at most one word in six of the run may be misread. Any such run has four
    words verbatim in a row once parted words are rejoined. Each shard of pages gets a suffix array over its
    words; every suffix of every passage is searched in it, and pages with
    enough verbatim matches are aligned word by word.

    The passages are a query set: slices of at most `slice_chars` characters
    (one passage at least) come to the driver and go to the tasks, which take a
    slice in blocks of 30,000 different words and 500,000 in all against each
    batch of pages. So the corpus is read once for each slice, whatever the
    number of blocks, nothing of it is shuffled, and what a task holds is bounded.

    Null texts, ids and empty pages give no row; passages under 20 words can't
    leak; repeated rows come once. No items or no pages: no rows.
    """
    spark = docs.sparkSession
    pages = docs.filter("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("line_boxes.x0").alias("x0"), F.col("line_boxes.y0").alias("y0"), F.col("line_boxes.x1").alias("x1"))
    asked = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("t")).filter("i is not null and length(t) > 0").distinct()
    chars = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = -(-chars // slice_chars)
    schema = "doc_id bigint, item_id bigint"
    found = None
    for k in range(slices):
        part = asked if slices == 1 else asked.filter(F.pmod(F.xxhash64("i"), F.lit(slices)) == k)
        blocks = _blocks(sorted(tuple(r) for r in part.collect()))
        if blocks:
            got = pages.mapInPandas(_search(blocks), schema)
            got = got if slices == 1 else stage(got, "leaks")  # a slice's passages are let go before the next ones come
            found = got if found is None else found.union(got)
    return spark.createDataFrame([], schema) if found is None else found.distinct()


def _blocks(items: list[tuple[int, str]]) -> list[list[tuple[int, list[str]]]]:
    """Passages of LEAST_RUN words or more as (id, words), in blocks of bounded vocabulary and size."""
    blocks, block, seen, size = [], [], set(), 0
    for i, text in items:
        ws = words(text)
        if len(ws) < LEAST_RUN:
            continue
        if block and (len(seen | set(ws)) > VOCABULARY or size + len(ws) > BLOCK_WORDS):
            blocks.append(block)
            block, seen, size = [], set(), 0
        block.append((i, ws))
        seen |= set(ws)
        size += len(ws)
    return [*blocks, block] if block else blocks


def _search(blocks: list[list[tuple[int, list[str]]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = [Passages(b) for b in blocks]
        for b in batches:
            tokens, bounds = [], [0]
            for text, x0, y0, x1 in zip(b["text"], b["x0"], b["y0"], b["x1"], strict=True):
                boxed = x0 is not None and all(v is not None for v in (y0, x1))
                page = as_printed(text, list(x0), list(y0), list(x1)) if boxed else text
                tokens += _TOKEN.findall(_BROKEN.sub("", page).casefold().translate(_DROPPED))
                tokens.append(PAGE_END)
                bounds.append(len(tokens))
            ids, bounds = b["doc_id"].to_numpy(), np.asarray(bounds)
            plain = [w for w in tokens if w != "\n"]
            real = np.array([k for k, w in enumerate(tokens) if w != "\n"], np.int64)  # line breaks are no words
            first = np.searchsorted(real, bounds)
            for passages in sets:
                out = [(int(ids[d]), i) for d, i in _found(passages, plain, real, first)]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return run


def _found(passages: Passages, plain: list[str], real: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """(page number, item id) of a batch: words of all pages, their places among words and line breaks, first word of each page."""
    number = passages.number
    codes = np.array(list(map(number.get, plain, repeat(0))), np.int64)
    hits = [passages.matches(codes)]
    joined, places = rejoined(plain, codes, number, passages.pairs)
    if len(places) < len(codes):
        i, p, n = passages.matches(joined)
        hits.append((i, places[p], n))
    i, p, n = (np.concatenate(x) for x in zip(*hits, strict=True))
    if not len(i):
        return
    item = np.searchsorted(passages.starts, i, "right") - 1
    doc = np.searchsorted(first, p, "right") - 1
    for (d, m), h in _groups(pd.DataFrame({"doc": doc, "item": item, "i": i - passages.starts[item], "p": p, "n": n}).drop_duplicates()):
        # a run of 20 words has a verbatim part of 5, or several of 4
        if h[:, 2].max() < SEED + 1 and len(h) < 2:
            continue
        key, ws = passages.items[m]
        have, lo_doc, hi_doc = set(ws), int(first[d]), int(first[d + 1])
        slack = len(ws) // 4 + 60
        # stretches of the page that a run through a hit can lie in, joined where they meet
        spans: list[list[int]] = []
        for lo, hi in sorted((max(lo_doc, int(hp - hi_) - slack), min(hi_doc, int(hp - hi_) + len(ws) + slack)) for hi_, hp, _ in h):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        at = np.concatenate([np.arange(lo, hi) for lo, hi in spans])
        piece = [plain[k] for k in at]
        if not enough(have, piece):
            continue
        tried: list[tuple[int, int]] = []
        for hi_, hp, _ in h:
            if any(lo <= hp < hi for lo, hi in tried):
                continue
            lo, hi = max(lo_doc, int(hp - hi_) - 60), min(hi_doc, int(hp - hi_) + len(ws) + 60)
            tried.append((lo + 60, hi - 60))
            if longest_run(ws, plain[lo:hi], np.cumsum(np.diff(real[lo:hi], prepend=real[lo]) > 1)):
                yield d, key
                break
        else:
            if chained_run(ws, piece, np.cumsum(np.diff(real[at], prepend=real[at[0]]) > 1)):
                yield d, key


def _groups(hits: pd.DataFrame) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    hits = hits.sort_values(["doc", "item", "n"], ascending=[True, True, False])
    key = hits[["doc", "item"]].to_numpy()
    rest = hits[["i", "p", "n"]].to_numpy()
    cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(key)], strict=True):
        yield (int(key[lo, 0]), int(key[lo, 1])), rest[lo:hi]
