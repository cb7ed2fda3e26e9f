"""A mixture of sources in which each gives its target share of all tokens."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.plans import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this public vocabulary splits text before its merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_SOURCES = 10_000
HIST_ROWS = 1 << 18  # rows of the tally the rates are set by, over all sources
THRESHOLDS = 1 << 22  # numbers in all sources' distributions together (32 MB)
_encodings: dict[str, object] = {}


def source_key(source: Column) -> Column:
    """Proper spelling of a source: trimmed, lower case, blanks as underscores. Null and blank are null."""
    s = F.regexp_replace(F.lower(F.trim(source)), r"[ _]+", "_")
    return F.when(s != "", s)


def ship_tokenizer(docs: DataFrame, path: str) -> None:
    """Send the vocabulary file to the executors, so that it need not lie at its path there."""
    docs.sparkSession.sparkContext.addFile(path)


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        try:
            own = SparkFiles.get(os.path.basename(path))
        except Exception:  # no file was sent
            own = path
        with open(own if os.path.exists(own) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of whole texts by a public byte-level tokenizer; null counts 0."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(tokenizer)
        for s in batches:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="int64")

    return count(text)


def _cdf(mean: float, cap: int) -> np.ndarray:
    """P(count <= k), k = 0..cap-1, of a Poisson count; places so far up that they are 1 are left out."""
    if math.isinf(mean):
        return np.zeros(cap)
    if mean <= 0:
        return np.ones(min(1, cap))
    k = np.arange(min(cap, int(mean + 12 * math.sqrt(mean) + 40)))
    logs = k * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(k[1:], 1)))])[: len(k)]
    return np.minimum(1.0, np.cumsum(np.exp(logs)))


def rate_for(mean: float, cap: int) -> float:
    """Poisson rate whose count, cut at `cap`, has the given mean; infinite where the mean is the cap."""
    if mean >= cap:
        return math.inf
    return _rate(lambda r: float((1 - _cdf(r, cap)).sum()), mean, cap)


def _rate(size_at, goal: float, cap: int) -> float:
    """The rate at which a size that grows with it comes nearest to the goal."""
    lo, hi = 0.0, 1.0
    while size_at(hi) < goal:
        lo, hi = hi, 2 * hi
        if hi > 1e3 * (cap + 100):
            return math.inf
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if size_at(mid) < goal else (lo, mid)
    return lo if goal - size_at(lo) < size_at(hi) - goal else hi


def uniform(seed: int) -> Column:
    """A number in (0, 1) that the page's id and the seed give."""
    return (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def sized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of each page of a known source, each doc_id once; the text is read once."""
    ship_tokenizer(docs, tokenizer)
    d = docs.filter("doc_id is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text").filter("source is not null")
    return d.select("doc_id", "source", count_tokens(F.col("text"), tokenizer).alias("n_tokens")).dropDuplicates(["doc_id"])


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[dict]:
    """For each target source its tokens, share, cap and mean number of uses of a page.

    Without `total_tokens` the mixture is as large as it can be with every
    source at its share: the source that runs out first, at its cap, sets it.
    A larger total leaves such sources below their share; the others share in
    what is missing by their targets. A source without tokens, cap or share has
    mean 0. The driver sees one row per source (checked: at most 100,000).
    """
    want = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).filter("source is not null")
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = want.join(have, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    out = [{"source": r["source"], "share": max(0.0, r["share"] or 0.0), "cap": max(0, r["cap"] or 0), "tokens": r["tokens"] or 0, "docs": r["docs"] or 0} for r in rows]
    live = [r for r in out if r["share"] > 0 and r["cap"] > 0 and r["tokens"] > 0]
    total_share = sum(r["share"] for r in live)
    if total_tokens is None:
        total_tokens = min((r["cap"] * r["tokens"] * total_share / r["share"] for r in live), default=0.0)
    left, open_ = float(total_tokens), list(live)
    for r in out:
        r["mean"] = 0.0
    while open_:  # sources at their cap first; what they can't give goes to the rest
        share = sum(r["share"] for r in open_)
        full = [r for r in open_ if left * r["share"] / share >= r["cap"] * r["tokens"]]
        if not full:
            for r in open_:
                r["mean"] = left * r["share"] / share / r["tokens"]
            break
        for r in full:
            r["mean"] = float(r["cap"])
        left = max(0.0, left - sum(r["cap"] * r["tokens"] for r in full))
        open_ = [r for r in open_ if r["mean"] == 0.0]
    return out


def rates(sizes: DataFrame, rows: list[dict], seed: int) -> dict[str, float]:
    """Poisson rate of each source of `plan` with a mean, such that its pages' counts use its part of the tokens.

    The counts follow from the pages' own numbers, so what a rate would use is
    known: a tally of tokens by source and number (at most HIST_ROWS rows, made
    by one aggregation) gives it. The rate found makes the source's tokens as
    near to the wanted as the tally's steps allow; a mean at the cap gives an
    infinite rate.
    """
    live = {r["source"]: r for r in rows if r["mean"] > 0}
    steps = max(16, min(1 << 14, HIST_ROWS // max(1, len(live))))
    tally = sizes.filter("n_tokens > 0").withColumn("step", F.floor(uniform(seed) * steps).cast("int")).groupBy("source", "step").agg(F.sum("n_tokens").alias("tokens"))
    spark = sizes.sparkSession
    names = spark.createDataFrame([(n,) for n in live], "source string")
    held = {n: np.zeros(steps) for n in live}
    for r in tally.join(F.broadcast(names), "source", "left_semi").toLocalIterator():  # one row per source of the plan
        held[r["source"]][r["step"]] = r["tokens"]
    middle = (np.arange(steps) + 0.5) / steps
    out = {}
    for n, r in live.items():
        goal, cap = r["mean"] * r["tokens"], r["cap"]
        out[n] = math.inf if r["mean"] >= cap else _rate(lambda rate: float(held[n] @ np.searchsorted(_cdf(rate, cap), middle, "left")), goal, cap)  # noqa: B023
    return out


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, shuffled: bool = True) -> DataFrame:
    """(doc_id, source, n_tokens, copy_no, position): each page as often as its Poisson count says, in a global random order.

    A page's count is a Poisson count, cut at the source's max_repeats, found by
    inverting the distribution at the number that the page's hash gives. The
    source's rate is set (`rates`) so that its pages together use its part of
    the tokens: the actual share is off by about one page's tokens, and by one
    part in the tally's steps. The same input and seed give the same mixture.
    Each page is then written out by its count, and the copies of all sources are shuffled globally: `position` is
    a random key, rows come out range-partitioned and sorted by it, unless
    `shuffled` is false (for sums, which need no order).

    Pages of null or unknown sources, and pages without tokens, are not used.
    Targets that name a source twice are added up. No targets: no rows.
    """
    spark = sizes.sparkSession
    rows = plan(sizes, targets, total_tokens)
    cap = {r["source"]: r["cap"] for r in rows}
    spec = [(n, _cdf(rate, cap[n]).tolist()) for n, rate in rates(sizes, rows, seed).items()]
    if sum(len(c) for _, c in spec) > THRESHOLDS:
        raise ValueError("the caps on repeats are too large for so many sources")
    cdf = spark.createDataFrame(spec, "source string, cdf array<double>")
    d = sizes.filter("n_tokens > 0").join(F.broadcast(cdf), "source").withColumn("u", uniform(seed))  # at most MAX_SOURCES rows, THRESHOLDS numbers
    d = d.withColumn("uses", F.size(F.filter("cdf", lambda c: F.col("u") > c)))
    d = d.filter("uses > 0").withColumn("copy_no", F.explode(F.expr("sequence(1, uses)")))
    d = d.select("doc_id", "source", "n_tokens", "copy_no", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)).alias("position"))
    order = ("position", "doc_id", "copy_no")
    return d.repartitionByRange(*order).sortWithinPartitions(*order) if shuffled else d


def actual_shares(mix: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and actual share of all tokens, tokens, pages, and the most uses of a page."""
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("pages"), F.max("copy_no").alias("most_repeats"))
    got = stage(got, "shares")
    total = got.agg(F.sum("tokens")).first()[0]
    want = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null")
    out = want.join(got, "source", "left").withColumn("total", F.lit(total).cast("long"))
    return out.select("source", "target_share", F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
