"""Long exact spans that stand in more than one text, to the character."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.plans import stage, tasks

SPAN = 400  # characters
# w: reach of a break's neighbourhood; GRAM: characters that rank a break in a text without natural ones
W, GRAM = 24, 12
MARGIN = 2 * W + GRAM + 2  # breaks this far inside a shared span are the same in both texts
CHUNK = 1 << 18  # characters handled at once
BROADCAST_IDS = 1_000_000

_M1, _M2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def run_length(span: int) -> int:
    """Least length of a run of units such that every shared span of `span` characters holds a whole run."""
    return span - 2 * MARGIN - 4 * W - 8


def _mixed(codes: np.ndarray, seed: int) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if mult not in _powers or len(_powers[mult][0]) < n:
        n = max(n, CHUNK + 1)
        inverse = pow(mult, -1, 1 << 64)
        _powers[mult] = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, m, np.uint64)])) for m in (mult, inverse))
    return _powers[mult]


class Hashes:
    """Hashes of any stretch of a code array in constant time."""

    def __init__(self, codes: np.ndarray, mult: int):
        up, self.down = _power(mult, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes, mult >> 7) * up[: len(codes)], out=self.sums[1:])

    def of(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return ((self.sums[to] - self.sums[at]) * self.down[at]).view(np.int64)


def _count(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _near(counts: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    n = len(counts) - 1
    return counts[np.minimum(at + reach + 1, n)] > counts[np.maximum(at - reach, 0)]


def breaks(codes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Starts of units: after line breaks; after sentence ends far from those; and, far from both, at ranked places.

    Each depends on the text within MARGIN only, and no unit is longer than
    2 W, so the same text gives the same units wherever it stands.
    """
    n = len(codes)
    line = np.zeros(n, bool)
    line[1:] = codes[:-1] == 10
    end = np.zeros(n, bool)
    end[2:] = (codes[1:-1] == 32) & np.isin(codes[:-2], (33, 46, 63))
    ends = np.flatnonzero(end & ~line)
    used = line
    used[ends[~_near(_count(line), ends, W)]] = True
    if n > W + GRAM:
        free = np.flatnonzero(~_near(_count(used), np.arange(len(grams)), W))
        if len(free):
            low = np.uint64((1 << 32) - 1)  # rank above, place below: of equal ranks the later place is taken
            key = (grams.view(np.uint64) & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
            m = len(key)
            pad = np.concatenate([key, np.full(-m % W + W, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, W)
            pre, suf = np.minimum.accumulate(pad, 1).ravel(), np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
            least = np.minimum(suf[:m], pre[W - 1: W - 1 + m])[: max(0, m - W + 1)]
            chosen = np.zeros(n, bool)
            chosen[(low - (least & low)).astype(np.int64)] = True
            used[free[chosen[free]]] = True
    return np.flatnonzero(used)


def runs(codes: np.ndarray, h: Hashes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, stop, hash of each run of units of at least `length` characters."""
    n = len(codes)
    g = np.arange(max(0, n - GRAM + 1))
    at = breaks(codes, h.of(g, g + GRAM))
    k = np.searchsorted(at, at + length)
    ok = k < len(at)
    start, stop = at[ok], at[k[ok]]
    return start, stop, h.of(start, stop)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, at, to, h, w, n): start, end and hash of every run of units of each text, hash of the `span` characters from its start (null where the text ends before), characters of the text."""
    length = run_length(span)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, bounds, codes in _chunks(b):
                h, h2 = Hashes(codes, _M1), Hashes(codes, _M2)
                start, stop, key = runs(codes, h, length)
                d = np.searchsorted(bounds, start, "right") - 1
                inside = stop <= bounds[d + 1]
                start, stop, key, d = start[inside], stop[inside], key[inside], d[inside]
                whole = start + span <= bounds[d + 1]
                w = pd.array(np.where(whole, h2.of(start, np.where(whole, start + span, start)), 0), "Int64")
                w[~whole] = pd.NA
                yield pd.DataFrame({"doc_id": ids[d], "at": (start - bounds[d]).astype(np.int32), "to": (stop - bounds[d]).astype(np.int32), "h": key, "w": w, "n": (bounds[d + 1] - bounds[d]).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, at int, to int, h bigint, w bigint, n int")


class Layout:
    """The runs of a text, in order of their starts, and which of them are repeated."""

    def __init__(self, start: np.ndarray, stop: np.ndarray, repeated: np.ndarray, span: int):
        self.start, self.stop, self.span = start, stop, span
        self.bad = _count(~np.isin(start, repeated))

    def first(self, at: np.ndarray) -> np.ndarray:
        """Number of the first run inside the window at each place."""
        return np.searchsorted(self.start, at + MARGIN)

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Places whose window has only repeated runs inside."""
        a, z = self.first(at), np.searchsorted(self.stop, at + self.span - MARGIN, "right")
        return at[self.bad[np.maximum(a, z)] == self.bad[a]]


def open_runs(rows: DataFrame, span: int) -> DataFrame:
    """(h) of the first runs of those windows that may be shared, but that no stretch of surely shared windows covers.

    rows: doc_id, at, kind and, of kind 0 (all runs of a text), to, h, n; of kind 1 the
    repeated runs, of kind 2 the surely shared windows of `span` characters.
    """
    def solve(g: pd.DataFrame) -> np.ndarray:
        kind, at = g["kind"].to_numpy(), g["at"].to_numpy(np.int64)
        own = kind == 0
        layout = Layout(at[own], g["to"].to_numpy()[own].astype(np.int64), at[kind == 1], span)
        key, sure, n = g["h"].to_numpy()[own], np.unique(at[kind == 2]), int(g["n"].to_numpy()[own][0])
        # only places near a repeated run can be candidates; of those covered, few are left
        found = []
        for lo in range(0, n - span + 1, CHUNK):
            p = layout.candidates(np.arange(lo, min(lo + CHUNK, n - span + 1)))
            if len(sure) and len(p):
                i = np.searchsorted(sure, p, "right") - 1
                j = np.minimum(i + 1, len(sure) - 1)
                p = p[~((i >= 0) & ((sure[np.maximum(i, 0)] == p) | ((j > i) & (sure[j] - sure[np.maximum(i, 0)] <= span))))]
            found.append((k := layout.first(p))[k < len(key)])
        return np.unique(key[np.unique(np.concatenate(found))]) if found else key[:0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            d = b["doc_id"].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            held = b.iloc[cut[-1]:]
            out = [solve(b.iloc[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            if out:
                yield pd.DataFrame({"h": np.unique(np.concatenate(out)).astype(np.int64)})
        if held is not None and len(held):
            yield pd.DataFrame({"h": solve(held).astype(np.int64)})

    return rows.repartition(tasks(rows), "doc_id").sortWithinPartitions("doc_id", "kind", "at").mapInPandas(run, "h bigint").distinct()


def _chunks(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, bounds and codes of texts put end to end, about CHUNK characters at a time (a longer text goes whole)."""
    ids, texts, size = [], [], 0
    for i, t in zip(b["doc_id"], b["text"], strict=True):
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= CHUNK:
            yield np.array(ids), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), _codes("".join(texts))
            ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), _codes("".join(texts))


def windows(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, at, h, h2): the hashes of each window of `span` characters of which all runs inside are `repeated` and the first is `asked`.

    docs: doc_id, text, repeated and asked (arrays of starts of the text's runs).
    """
    length = run_length(span)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text, good, asked in zip(b["doc_id"], b["text"], b["repeated"], b["asked"], strict=True):
                codes = _codes(text)
                h, h2 = Hashes(codes, _M1), Hashes(codes, _M2)
                start, stop, _ = runs(codes, h, length)
                layout, wanted = Layout(start, stop, np.asarray(good), span), np.append(np.isin(start, np.asarray(asked)), True)
                for lo in range(0, len(codes) - span + 1, CHUNK):  # a very long text goes on in parts
                    at = layout.candidates(np.arange(lo, min(lo + CHUNK, len(codes) - span + 1)))
                    at = at[wanted[layout.first(at)]]
                    if len(at):
                        yield pd.DataFrame({"doc_id": doc, "at": at.astype(np.int32), "h": h.of(at, at + span), "h2": h2.of(at, at + span)})

    return docs.select("doc_id", "text", "repeated", "asked").mapInPandas(run, "doc_id bigint, at int, h bigint, h2 bigint")


def _few(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df marked for broadcast if it is written and has at most `limit` rows of a few numbers; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def shared_spans(docs: DataFrame, span: int = SPAN, later_only: bool = False) -> DataFrame:
    """(doc_id, span_start, span_end) of each longest unbroken stretch of shared characters.

    A character is shared if it lies in a stretch of at least `span` characters,
    line breaks included, that also stands in another doc_id's text. Starts
    count from 0, ends are exclusive.

    Runs of several consecutive units (lines, sentences) are hashed and joined
    globally; every shared stretch holds whole runs, as unit bounds depend on the
    text near them only. Of the repeated runs, those that also go on alike up to
    `span` characters give the stretches but for their ends. There, to the
    character, each window of `span` characters that may be shared and is not
    yet covered is hashed and joined, in all texts that hold the window's first
    run: so a stretch costs a row per run and some 200 for its ends, not a row a
    character. Equal whole texts are grouped first. All joins are aggregations with map-side combine and semi joins: no pairs
    arise, and a run that a third of all texts share is no hot group.

    Null ids and texts and texts under `span` characters take no part; repeated
    rows of one doc_id count once. Empty input: no rows. `span` must be 272 or more.
    With `later_only`, a stretch counts only where a text of a lesser doc_id has it.
    """
    if run_length(span) < 48:
        raise ValueError("span is too short for runs of units")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null").filter(F.length("text") >= span)
    whole = stage(docs.select("doc_id", F.length("text").alias("n"), F.md5(F.encode("text", "UTF-8")).alias("m"), F.xxhash64("text").alias("x")).distinct(), "texts")
    kinds = stage(whole.groupBy("n", "m", "x").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last"), "copies")
    copies = stage(whole.join(kinds, ["n", "m", "x"]).select("doc_id", "n", "rep"), "copied")
    spare = _few(stage(copies.filter("doc_id <> rep").select("doc_id"), "spare"))
    docs = docs.join(spare, "doc_id", "left_anti")
    runs_ = stage(anchors(docs, span), "runs")
    met = runs_.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h")
    again = stage(runs_.join(_few(stage(met, "met")), "h", "left_semi"), "again")
    # windows that begin with a repeated run: where they stand twice, they are shared
    twice = again.filter("w is not null").groupBy("h", "w").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h", "w", "a")
    sure = again.join(stage(twice, "twice"), ["h", "w"])
    sure = stage((sure.filter("doc_id > a") if later_only else sure).select("doc_id", "at"), "sure")
    ids = _few(stage(again.select("doc_id").distinct(), "ids"))
    none = {"to": F.lit(0), "h": F.lit(0).cast("bigint"), "n": F.lit(0)}  # no nulls: hashes must stay whole numbers
    kinds_ = runs_.join(ids, "doc_id", "left_semi").select("doc_id", "at", F.lit(0).alias("kind"), "to", "h", "n")
    for k, part in ((1, again), (2, sure)):
        kinds_ = kinds_.union(part.select("doc_id", "at", F.lit(k).alias("kind"), *[v.alias(c) for c, v in none.items()]))
    asked = stage(open_runs(kinds_, span), "asked").withColumn("ask", F.lit(True))
    marked = again.join(_few(asked), "h", "left").groupBy("doc_id").agg(F.collect_set("at").alias("repeated"), F.collect_set(F.when(F.col("ask"), F.col("at"))).alias("asked"))
    marked = stage(marked.filter("size(asked) > 0"), "marked")
    texts = docs.join(_few(marked.select("doc_id")), "doc_id", "left_semi").join(marked, "doc_id")
    rows = stage(windows(texts, span), "windows")
    both = rows.groupBy("h", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h", "h2", *["a"] * later_only)
    if later_only:
        hits = rows.join(both.withColumnRenamed("a", "first"), ["h", "h2"]).filter("doc_id > first").select("doc_id", "at").union(sure)
        copies = copies.filter("doc_id <> rep")
    else:
        hits = rows.join(both, ["h", "h2"], "left_semi").select("doc_id", "at").union(sure).join(_few(copies.select("doc_id")), "doc_id", "left_anti")
    near = hits.repartition("doc_id").sortWithinPartitions("doc_id", "at")

    def islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if held is not None:
                b = pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            d, a = b["doc_id"].to_numpy(), b["at"].to_numpy()
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > a[:-1] + span)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:] - 1, [len(b) - 1]])
            yield pd.DataFrame({"doc_id": d[first[:-1]], "span_start": a[first[:-1]], "span_end": a[last[:-1]] + span})
            held = b.iloc[[first[-1], last[-1]]] if first[-1] != last[-1] else b.iloc[[first[-1]]]
            if len(held) == 2 and held["at"].iloc[1] > held["at"].iloc[0] + span:  # keep the open stretch unbroken in what is carried on
                lo, hi = int(held["at"].iloc[0]), int(held["at"].iloc[1])
                held = pd.DataFrame({"doc_id": d[first[-1]], "at": np.unique(np.append(np.arange(lo, hi, span), hi))})
        if held is not None and len(held):
            yield pd.DataFrame({"doc_id": [held["doc_id"].iloc[0]], "span_start": [held["at"].iloc[0]], "span_end": [held["at"].iloc[-1] + span]})

    found = near.mapInPandas(islands, "doc_id bigint, span_start bigint, span_end bigint")
    return found.unionByName(copies.select("doc_id", F.lit(0).cast("long").alias("span_start"), F.col("n").cast("long").alias("span_end")))


_SENTENCE = re.compile(r"\S.*?(?:[.!?]+(?=\s|\Z)|\Z)\s*", re.DOTALL)


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, text, removed_chars): the texts without the sentences that a repeated stretch covers wholly, but for its first text.

    The first text of a stretch is that of the least doc_id; it keeps it. A
    sentence ends with a full stop, question or exclamation mark before a blank
    or the end of the text. Each distinct row of docs gives a row, also an emptied one.
    """
    later = shared_spans(docs, span, later_only=True).groupBy("doc_id").agg(F.collect_list(F.struct("span_start", "span_end")).alias("cut"))
    later = later.select("doc_id", F.flatten(F.transform("cut", lambda c: F.array(c["span_start"], c["span_end"]))).alias("cut"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = []
            for text, cut in zip(b["text"], b["cut"], strict=True):
                if text is not None and cut is not None:
                    pairs = np.asarray(cut).reshape(-1, 2).tolist()
                    text = _SENTENCE.sub(lambda m: "" if any(lo <= m.start() and m.start() + len(m[0].rstrip()) <= hi for lo, hi in pairs) else m[0], text)
                kept.append(text)
            gone = [0 if k is None else len(t) - len(k) for t, k in zip(b["text"], kept, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": kept, "removed_chars": gone})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").distinct().join(later, "doc_id", "left")
    return rows.mapInPandas(run, "doc_id bigint, text string, removed_chars bigint")
