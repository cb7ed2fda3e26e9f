"""Oversized items cut at natural boundaries: image extents between objects, giant files between sentences.

Both run in the same three steps. Ranges of an item are looked at each on its
own, with a halo: for every place where the first cut of the range may lie, a
table says how many cuts follow in the range and where the next range begins
(`follow`). The tables of an item are stitched in order, the numbers of cuts
summed up (`stitched`). Then each range, told its first cut, gives its pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.plans import stage, tasks

LIMIT_PX, OVERLAP_PX = 512, 64
RANGE_PX = 1 << 15  # px of an item's side that one step looks at
RANGE_BYTES = 4 << 20
BOUNDARIES = ("paragraph", "line", "sentence", "word", "none")
_TABLE = "lo array<bigint>, goes array<bigint>, last array<bigint>, n array<bigint>"


def follow(next_of: Callable[[np.ndarray], np.ndarray], entries: np.ndarray, stop: int) -> tuple[np.ndarray, ...]:
    """For runs of entries of one outcome: first entry, first cut at or after `stop` (-1: no more cuts), last cut before it (-1: the entry), number of cuts before it, the entry among them.

    next_of gives the cut that follows each cut, -1 where the item ends. An entry counts as a cut.
    """
    at, last, n = entries.copy(), entries.copy(), np.ones(len(entries), np.int64)
    live = np.flatnonzero((at >= 0) & (at < stop))
    while len(live):
        to = next_of(at[live])
        last[live], at[live] = at[live], to
        live = live[(to >= 0) & (to < stop)]
        n[live] += 1
    last[n == 1] = -1  # the entry itself
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (last[1:] != last[:-1]) | (n[1:] != n[:-1])])
    return entries[new], at[new], last[new], n[new]


def stitched(tables: DataFrame, key: list[str], first: str) -> DataFrame:
    """(key, range, enter, before, k) of each range of an item in which a cut lies.

    tables: key, range (0, 1, ...), start, the columns of `_TABLE`, and `first`,
    the item's virtual cut before its first. enter is the first cut in the
    range, before the cut ahead of it, k the number of cuts ahead of it. The
    tables of an item, a few rows a range, stream through one task in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in tables.schema}
    names = [*key, "range", "enter", "before", "k"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, at, before, k = None, -1, -1, 0
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                own = row[: len(key)]
                if own != item:
                    item, at, before, k = own, getattr(row, first), -1, 0
                if at < 0 or at >= row.stop:
                    continue
                out.append((*own, row.range, at, before, k))
                j = int(np.searchsorted(row.lo, at, "right")) - 1
                # entries of a run share what follows; the last cut is the entry itself where no other follows in the range
                n = int(row.n[j])
                before = at if n == 1 else int(row.last[j])
                at, k = int(row.goes[j]), k + n
            yield pd.DataFrame(out, columns=names)

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in key], f"range {kinds['range']}", "enter bigint", "before bigint", "k bigint"])
    rows = tables.select(*key, "range", "stop", first, "lo", "goes", "last", "n")
    return rows.repartition(*key).sortWithinPartitions(*key, "range").mapInPandas(run, schema)


def oversized(items: DataFrame, limit: int = LIMIT_PX) -> DataFrame:
    """Items (kind, id, width, height in px) wider or higher than the limit; an item null in either size takes no part."""
    return items.filter(F.col("width").isNotNull() & F.col("height").isNotNull() & (F.greatest("width", "height") > limit))


def _free_next(a: np.ndarray, b: np.ndarray, lo: int, hi: int, reach: int, length: float) -> Callable[[np.ndarray], np.ndarray]:
    """The cut that follows each cut: the last whole px within reach that lies in no span (a, b); else the last within reach."""
    cover = np.zeros(hi - lo + 2, np.int64)
    inside = b - a > 1
    np.add.at(cover, np.clip(a[inside] + 1 - lo, 0, hi - lo + 1), 1)
    np.add.at(cover, np.clip(b[inside] - lo, 0, hi - lo + 1), -1)
    free = np.flatnonzero(np.cumsum(cover)[: hi - lo + 1] == 0) + lo

    def next_of(at: np.ndarray) -> np.ndarray:
        j = np.searchsorted(free, at + reach, "right") - 1
        place = free[np.maximum(j, 0)] if len(free) else at
        to = np.where((j >= 0) & (place > at), place, at + reach)
        return np.where(at + reach >= length, -1, to)

    next_of.free = free
    return next_of


def cut_axis(items: DataFrame, spans: DataFrame, limit: int, overlap: int, range_px: int = RANGE_PX) -> DataFrame:
    """Pieces (kind, id, axis, k, lo, hi, natural) of one-dimensional items (kind, id, axis, length).

    From the left, each cut is the last whole place that lies in no span (kind,
    id, axis, a, b) and leaves no piece over `limit`; where there is none, the
    last place within the limit, marked not natural. No other choice makes
    fewer cuts through spans. Piece k runs from the cut before, less `overlap`, to its cut.
    """
    reach = limit - overlap
    if overlap < 0 or reach <= overlap:
        raise ValueError("limit must exceed twice the overlap")
    key = ["kind", "id", "axis"]
    ranges = items.filter("length > 0").select(*key, F.col("length").cast("double").alias("length"), F.explode(F.expr(f"sequence(0L, cast(floor((length - 0.001) / {range_px}) as bigint))")).alias("range"))
    # of the spans that begin at one place, the longest says all; a range also needs those a reach beyond it
    s = spans.select(*key, F.floor("a").cast("long").alias("a"), F.ceil("b").cast("long").alias("b")).filter("b - a > 1")
    s = s.withColumn("range", F.explode(F.expr(f"sequence(greatest(0L, cast(floor((a - {reach}) / {range_px}) as bigint)), greatest(0L, cast(floor(b / {range_px}) as bigint)))")))
    low, high = F.col("range") * range_px - 1, (F.col("range") + 1) * range_px + reach + 1
    s = s.select(*key, "range", F.greatest("a", low).alias("a"), F.least("b", high).alias("b")).groupBy(*key, "range", "a").agg(F.max("b").alias("b"))
    none = F.lit(None).cast("long")
    rows = stage(ranges.select(*key, "range", "length", none.alias("a"), none.alias("b")).unionByName(s.select(*key, "range", F.lit(None).cast("double").alias("length"), "a", "b")), "ranges")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*key).schema)

    def by_range(make: Callable, columns: list[str]) -> Callable:
        """Runs `make` on each range: its row (the one with a length) and its spans, streamed in key order."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for b in batches:
                b = b if held is None else pd.concat([held, b], ignore_index=True)
                if not len(b):
                    continue
                new = np.zeros(len(b), bool)
                for c in (*key, "range"):
                    v = b[c].to_numpy()
                    new[1:] |= v[1:] != v[:-1]
                new[0] = True
                cut = np.flatnonzero(new)
                held = b.iloc[cut[-1]:]
                yield frame([b.iloc[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)])
            if held is not None and len(held):
                yield frame([held])

        def frame(groups: list[pd.DataFrame]) -> pd.DataFrame:
            out = []
            for g in groups:
                head = g.iloc[0]
                if head["length"] == head["length"]:  # not of a span whose range the item has not, or that has no cut
                    r = int(head["range"])
                    lo, hi = r * range_px, (r + 1) * range_px
                    next_of = _free_next(g["a"].to_numpy()[1:].astype(np.int64), g["b"].to_numpy()[1:].astype(np.int64), lo, int(min(hi + reach, head["length"])), reach, float(head["length"]))
                    out += [(*(head[c] for c in key), *v) for v in make(head, r, lo, hi, next_of)]
            return pd.DataFrame(out, columns=[*key, *columns])

        return run

    def table(head: pd.Series, r: int, lo: int, hi: int, next_of: Callable) -> list[tuple]:
        stop = int(min(hi, np.ceil(head["length"])))
        entries = np.arange(lo, min(lo + reach, stop), dtype=np.int64) if r else np.array([overlap])
        return [(r, max(stop, overlap + 1), overlap, *(x.tolist() for x in follow(next_of, entries, hi)))]

    def pieces(head: pd.Series, r: int, lo: int, hi: int, next_of: Callable) -> list[tuple]:
        at, before, k, out = int(head["enter"]), int(head["before"]), int(head["k"]), []
        free = set(next_of.free.tolist()) if len(next_of.free) < 64 else next_of.free
        natural = (lambda c: c in free) if isinstance(free, set) else (lambda c: bool((i := np.searchsorted(free, c)) < len(free) and free[i] == c))
        while 0 <= at < hi:
            if k:  # cut 0 is the virtual one before the item
                out.append((k, float(before - overlap), float(at), natural(at)))
            to = int(next_of(np.array([at]))[0])
            if to < 0:
                out.append((k + 1, float(at - overlap), float(head["length"]), True))
            before, at, k = at, to, k + 1
        return out

    order = [*key, "range", F.col("length").isNull(), "a"]
    n = tasks(items)
    tables = rows.repartition(n, *key, "range").sortWithinPartitions(*order).mapInPandas(by_range(table, ["range", "stop", "first", "lo", "goes", "last", "n"]), f"{kinds}, range bigint, stop bigint, first bigint, {_TABLE}")
    begin = stitched(tables, key, "first")
    told = rows.filter("length is not null").join(begin, [*key, "range"]).unionByName(rows.filter("length is null").select("*", none.alias("enter"), none.alias("before"), none.alias("k")))
    out = told.repartition(n, *key, "range").sortWithinPartitions(*order).mapInPandas(by_range(pieces, ["k", "lo", "hi", "natural"]), f"{kinds}, k bigint, lo double, hi double, natural boolean")
    return out


def cut_items(items: DataFrame, objects: DataFrame, limit: int = LIMIT_PX, overlap: int = OVERLAP_PX, range_px: int = RANGE_PX) -> DataFrame:
    """Pieces (kind, id, piece_x, piece_y, x0, y0, x1, y1, natural) of the oversized items, in pixels from the top left.

    Together they cover the item; none is over `limit` wide or high;
    consecutive ones overlap by `overlap`; cuts lie between the objects (kind,
    id, l, t, r, b) where possible, else natural is false. Items within the
    limit, and nulls, have no rows; repeated items are cut once.
    """
    big = oversized(items, limit).select("kind", "id", "width", "height").distinct()
    both = lambda x, y: F.explode(F.array(F.struct(F.lit("x").alias("axis"), *x), F.struct(F.lit("y").alias("axis"), *y))).alias("s")
    axes = big.select("kind", "id", both([F.col("width").alias("length")], [F.col("height").alias("length")])).select("kind", "id", "s.*")
    known = objects.filter("kind is not null and id is not null").join(big.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    spans = known.select("kind", "id", both([F.col("l").alias("a"), F.col("r").alias("b")], [F.col("t").alias("a"), F.col("b").alias("b")])).select("kind", "id", "s.*")
    p = stage(cut_axis(axes, spans, limit, overlap, range_px), "cuts")
    x = p.filter("axis = 'x'").select("kind", "id", F.col("k").alias("piece_x"), F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("natural").alias("nx"))
    y = p.filter("axis = 'y'").select("kind", "id", F.col("k").alias("piece_y"), F.col("lo").alias("y0"), F.col("hi").alias("y1"), F.col("natural").alias("ny"))
    return x.join(y, ["kind", "id"]).select("kind", "id", "piece_x", "piece_y", "x0", "y0", "x1", "y1", (F.col("nx") & F.col("ny")).alias("natural"))


def boundaries(chunk: bytes, base: int) -> list[np.ndarray]:
    """Places in the file (ends of paragraphs, lines, sentences, words; starts of characters) in a chunk that begins at base; each told by three bytes before it."""
    c = np.frombuffer(chunk, np.uint8)
    b = np.concatenate([np.zeros(3, np.uint8), c])  # b[i + 3] is c[i]
    one, two, three = b[2:-1], b[1:-2], b[:-3]
    line = c == 10
    blank = (c == 32) | (c == 9)
    stop = lambda x: (x == 46) | (x == 33) | (x == 63)
    closing = (one == 34) | (one == 39) | (one == 41) | (one == 93)
    del three
    kinds = (line & ((one == 10) | ((one == 13) & (two == 10))), line, blank & (stop(one) | (closing & stop(two))), blank)
    return [*[np.flatnonzero(k) + 1 + base for k in kinds], np.flatnonzero((c & 0xC0) != 0x80) + base]


def _text_next(chunk: bytes, base: int, reach: int, window: int, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """The cut that follows each cut: the last boundary of the best kind in the last `window` bytes within reach; else the last of any kind within reach; else between characters."""
    places = boundaries(chunk, base)

    def last_of(kind: np.ndarray, at: np.ndarray, past: np.ndarray) -> np.ndarray:
        j = np.searchsorted(kind, at + reach, "right") - 1
        p = kind[np.maximum(j, 0)] if len(kind) else np.full(len(at), -1)
        return np.where((j >= 0) & (p > past), p, -1)

    def next_of(at: np.ndarray, told: list | None = None) -> np.ndarray:
        to, kind = np.full(len(at), -1), np.full(len(at), len(BOUNDARIES) - 1)
        for past in (at + reach - window, at):
            for k in range(4):
                p = last_of(places[k], at, past)
                new = (to < 0) & (p >= 0)
                to, kind = np.where(new, p, to), np.where(new, k, kind)
        p = last_of(places[4], at, at)
        to = np.where(to < 0, np.where(p >= 0, p, at + reach), to)
        if told is not None:
            told.extend(kind.tolist())
        return np.where(at + reach >= size, -1, to)

    return next_of


def _read(path: str, lo: int, hi: int) -> bytes:
    from pyarrow import fs

    at = path.removeprefix("file:") if path.startswith("file:") else path
    f, at = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)
    with f.open_input_file(at) as h:
        return h.read_at(max(0, hi - lo), lo)


def cut_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, window: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece, start, stop, boundary, text) of giant text files, cut by byte ranges.

    Each range is read on its own with a halo of one piece. Cuts are greedy
    from the start of the file: each lies at the last paragraph, else line,
    sentence, word end in the last `window` bytes that fit a piece; where there
    is none, at the last one of any kind that fits, else between characters. A piece is at most `limit`
    bytes and starts `overlap` bytes (rounded forward to a whole character)
    before the last one ended. An empty file has one empty piece. Paths may be
    of any filesystem pyarrow knows. No task reads more than a range and its halo.
    """
    from pyarrow import fs

    reach = limit - overlap
    if overlap < 0 or reach <= overlap or not 4 <= window <= reach or range_bytes < limit:
        raise ValueError("limit must exceed twice the overlap, the window fit in it, and a range hold a piece")
    infos = []
    for p in paths:
        plain = p.removeprefix("file:") if p.startswith("file:") else p
        f, at = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
        infos.append((p, f.get_file_info(at).size))
    files = spark.createDataFrame(infos, "path string, size long")
    ranges = files.withColumn("range", F.explode(F.expr(f"sequence(0L, greatest(0L, (size - 1) div {range_bytes}))")))
    n = max(1, min(20_000, sum(s // range_bytes + 1 for _, s in infos)))

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, size, r in b.itertuples(index=False):
                lo, hi = r * range_bytes, (r + 1) * range_bytes
                base = max(0, lo - 3)
                next_of = _text_next(_read(path, base, min(size, hi + reach + 1)), base, reach, window, size)
                entries = np.arange(lo, min(lo + reach, size), dtype=np.int64) if r else np.array([overlap])
                out.append((path, r, min(hi, max(size, overlap + 1)), overlap, *(x.tolist() for x in follow(next_of, entries, hi))))
            yield pd.DataFrame(out, columns=["path", "range", "stop", "first", "lo", "goes", "last", "n"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, r, at, before, k in b[["path", "size", "range", "enter", "before", "k"]].itertuples(index=False):
                hi, out = (r + 1) * range_bytes, []
                base = max(0, min(before, at) - overlap - 3) if k else 0
                body = _read(path, base, min(size, hi + reach + 1))
                next_of = _text_next(body, base, reach, window, size)
                kind: list[int] = []
                if k:
                    next_of(np.array([before]), kind)

                def piece(number: int, start: int, stop: int, why: str) -> tuple:
                    skip = next((i for i, c in enumerate(body[start - base: start - base + 4]) if c & 0xC0 != 0x80), 0) if start else 0  # noqa: B023
                    return path, number, start + skip, stop, why, body[start + skip - base: stop - base].decode("utf-8", "replace")  # noqa: B023

                while 0 <= at < hi:
                    if k:
                        out.append(piece(k, before - overlap, at, BOUNDARIES[kind[-1]]))
                    to = int(next_of(np.array([at]), kind)[0])
                    if to < 0:
                        out.append(piece(k + 1, at - overlap, size, "end"))
                    before, at, k = at, to, k + 1
                yield pd.DataFrame(out, columns=["path", "piece", "start", "stop", "boundary", "text"])

    tables = ranges.repartition(n, "path", "range").mapInPandas(table, f"path string, range bigint, stop bigint, first bigint, {_TABLE}")
    begin = stitched(tables, ["path"], "first")
    told = ranges.join(begin, ["path", "range"]).select("path", "size", "range", "enter", "before", "k")
    return told.repartition(n, "path", "range").mapInPandas(emit, "path string, piece long, start long, stop long, boundary string, text string")
