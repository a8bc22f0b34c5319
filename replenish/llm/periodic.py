"""Runs of repeated words, by internal pattern matching inside each text.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are identical), at least ``min_periods * q`` and ``min_length`` words
long, that no neighbouring word extends. The runs of a slice of texts are found
together:

1. Suffixes are ranked by prefix doubling, text before word, and the rank of
   every dyadic length 1, 2, 4, ... is kept; the last one gives the suffix array.
2. Every block of b = 2, 4, 8, ... words at a multiple of b asks for its
   occurrences b/2 to b-1 words to its right and to its left. They lie in the
   suffix array's interval of the block; a wavelet tree over that array
   answers how many there are, the first one and its successor.
3. One occurrence gives its distance as candidate period. Several are an
   arithmetic progression: the block itself then has the period d of their steps,
   and the ends of the two stretches of period d around block and
   progression give the candidates.
4. A candidate is extended to both sides with the dyadic ranks and kept if it is
   long enough; of candidates with one extent the smallest period is the period.

Every run is found: one of at least 4q words holds an aligned block with
q < b <= 2q among its first words, and a copy of it q to the right or left.

Defined results: a null, empty or blank text has no words, no runs and an empty
collapsed text; ids may be null or repeated and any type, each row is
handled alone; other columns are ignored whatever their names; an empty table
gives an empty table. A task holds some 200 bytes a word of the slice that it
is at: SLICE_WORDS words, or one text if that is longer.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Words handled at once; a longer text is a slice of its own.
SLICE_WORDS = 120_000
MIN_LENGTH = 6
MIN_PERIODS = 4
#: What separates words, as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"


class Runs(NamedTuple):
    """Runs of a slice, ordered by place, then period; places count from the slice's first word."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class Suffixes:
    """Dyadic ranks of all suffixes of a slice, and what its repeated blocks look like.

    ``ranks[k][i]`` is the place in the suffix array of the first suffix that
    shares its text and first 2**k words with suffix i.
    """

    def __init__(self, word: np.ndarray, text: np.ndarray, stop: np.ndarray):
        n = len(word)
        key = text * (int(word.max()) + 1) + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.append(True, key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.ranks = [rank]
        self.blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # block length, places, interval
        active, size = self._shared(order, fresh)
        self.paired = np.zeros(0, np.int64)  # suffixes that share their first two words with another
        width = 1
        while len(active):
            old = rank[active]
            follow = active + width
            key = old * (n + 1) + np.where(follow < stop[active], rank[np.minimum(follow, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            key, old, active = key[order], old[order], active[order]
            at = np.arange(len(active))
            first = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
            place = old + at - first
            fresh = np.append(True, key[1:] != key[:-1])
            rank = rank.copy()
            rank[active] = np.maximum.accumulate(np.where(fresh, place, 0))
            self.ranks.append(rank)
            active, size = self._shared(active, fresh)
            width *= 2
            if width == 2:
                self.paired = active
            whole = active % width == 0
            self.blocks.append((width, active[whole], rank[active[whole]], size[whole]))
        self.array = np.empty(n, np.int64)
        self.array[rank] = np.arange(n)

    @staticmethod
    def _shared(order: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of groups of two or more, and the size of each one's group."""
        first = np.flatnonzero(fresh)
        size = np.repeat(np.diff(np.append(first, len(order))), np.diff(np.append(first, len(order))))
        many = size > 1
        return order[many], size[many]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same (i and j differ)."""
        n, far = len(self.array), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i + far, j + far
            inside = (a < n) & (b < n)
            rank = self.ranks[k]
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            far += same.astype(np.int64) << k
        return far

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i and up to j are the same."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - far - (1 << k) + 1, j - far - (1 << k) + 1
            rank = self.ranks[k]
            same = (a >= 0) & (b >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            far += same.astype(np.int64) << k
        return far


class WaveletTree:
    """Counts and order statistics over index ranges of an array of numbers below ``top``."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.append(0, np.cumsum(~one)).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are smaller than ``bound``."""
        every = bound >= 1 << self.bits
        total = hi - lo
        x, found = np.clip(bound, 0, (1 << self.bits) - 1), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[lo], zeros[hi]
            found += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return np.where(every, total, found)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value of each range that has ``nth`` smaller ones."""
        value = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[lo], zeros[hi]
            one = nth >= b - a
            nth = np.where(one, nth - (b - a), nth)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return value


def candidates(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): the words from place on equal those a period later, for a block's length."""
    n = len(s.array)
    shared = np.zeros(n, np.int64)
    shared[s.paired] = 1
    shared = shared[s.array]
    tree = WaveletTree(s.array[shared == 1], n)
    moved = np.append(0, np.cumsum(shared))
    blocks = [b for b in s.blocks if len(b[1])]
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = np.concatenate([np.full(len(at), b) for b, at, _, _ in blocks])
    at = np.concatenate([b[1] for b in blocks])
    lo = moved[np.concatenate([b[2] for b in blocks])]
    hi = lo + np.concatenate([b[3] for b in blocks])
    half = width // 2
    # The windows to the right and to the left, one after the other.
    width, at, lo, hi = (np.tile(x, 2) for x in (width, at, lo, hi))
    begin = np.concatenate([at[: len(half)] + half, at[: len(half)] - width[: len(half)] + 1])
    skipped = tree.below(lo, hi, begin)
    found = tree.below(lo, hi, begin + np.tile(half, 2)) - skipped
    hit = found > 0
    width, at, lo, hi, skipped, found = (x[hit] for x in (width, at, lo, hi, skipped, found))
    first = tree.smallest(lo, hi, skipped)
    several = found > 1
    place, period = [np.minimum(at, first)[~several]], [np.abs(at - first)[~several]]
    width, at, lo, hi, skipped, first = (x[several] for x in (width, at, lo, hi, skipped, first))
    if len(at):
        step = tree.smallest(lo, hi, skipped + 1) - first
        sign = np.where(first > at, 1, -1)
        right = (first + s.ahead(first, first + step)) - (at + s.ahead(at, at + step))
        left = (first - s.behind(first - 1, first - 1 + step)) - (at - s.behind(at - 1, at - 1 + step))
        for gap in (right * sign, left * sign):
            ok = (gap >= width // 2) & (gap < width)
            place.append(np.where(sign > 0, at, at - gap)[ok])
            period.append(gap[ok])
    return np.concatenate(place), np.concatenate(period)


def find_runs(word: np.ndarray, text: np.ndarray, stop: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> Runs:
    """Runs of a slice: word numbers, the text of each word and where that text ends."""
    if min_periods < 4:
        raise ValueError("blocks of the method need runs of four periods or more")
    if not len(word):
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)))
    s = Suffixes(word, text, stop)
    place, period = candidates(s)
    start = place - s.behind(place - 1, place - 1 + period)
    end = place + period + s.ahead(place, place + period)
    ok = end - start >= np.maximum(min_length, min_periods * period)
    start, end, period = start[ok], end[ok], period[ok]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return Runs(start[order], (end - start)[order], period[order])


def kept_words(runs: Runs, n: int) -> np.ndarray:
    """Whether each word stays when every run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:n]) == 0


def _slices(texts: list[bytes]):
    """(first row, words of each row) with about SLICE_WORDS words together."""
    lo, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.split())
        total += len(held[-1])
        if total >= SLICE_WORDS:
            yield lo, held
            lo, held, total = i + 1, [], 0
    if held:
        yield lo, held


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(texts: list[bytes], min_length: int, min_periods: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    n_words, n_runs, runs, collapsed = [], [], [], []
    for _, rows in _slices(texts):
        number = defaultdict(count().__next__)  # exact: a number for each word of the slice
        sizes = np.array([len(r) for r in rows], np.int64)
        total = int(sizes.sum())
        word = np.fromiter((number[w] for r in rows for w in r), np.int64, total)
        bound = np.append(0, np.cumsum(sizes))
        text = np.repeat(np.arange(len(rows)), sizes)
        found = find_runs(word, text, bound[1:][text], min_length, min_periods)
        owner = text[found.start]
        runs.append((found.start - bound[owner], found.length, found.period))
        n_runs.append(np.bincount(owner, minlength=len(rows)))
        n_words.append(sizes)
        keep = kept_words(found, total)
        for r, row in enumerate(rows):
            if n_runs[-1][r]:
                row = compress(row, keep[bound[r] : bound[r + 1]].tolist())
            collapsed.append(b" ".join(row))
    fields = [pa.array(np.concatenate(x)) for x in zip(*runs)]
    offsets = np.append(0, np.cumsum(np.concatenate(n_runs))).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(RUN)))
    return pa.array(np.concatenate(n_words)), listed, pa.array(collapsed, pa.binary()).cast(pa.string())


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(id, n_words, runs, collapsed) of every whole text.

    ``runs`` holds (start, length, period) by start, then period, words
    numbered from 0; ``collapsed`` is the text without the words that a run
    holds after its first period, words joined by one blank.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *_batch(texts, min_length, min_periods)], names=["i", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    out = map_batches(plain, run, f"i {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("i", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the contract's texts; one document in ten repeats a stretch of its own words.

    With h the crc32 of the decimal id and g = h div 10, a document with h mod 10 = 0
    and n > 0 words keeps those before word a = g mod n and repeats the next
    p = 1 + (n - a) div (3 + g mod 8) up to its old length. A null id has no h.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.array_remove(F.split(F.col(text_col), BLANKS), "")
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    out = out.withColumn("n", F.size("w").cast("long"))
    out = out.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    left = F.col("n") - F.col("a")
    out = out.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil(left / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    made = F.array_join(F.slice(F.concat(F.slice("w", 1, F.col("a")), tail), F.lit(1), F.col("n").cast("int")), " ")
    return out.select(F.col("i").alias(id_col), F.when(F.col("n") > 0, made).otherwise(F.col("t")).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a text: number of runs, the one of greatest exponent, digests of all runs and of the collapsed text."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, better)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top: dict[str, Column] = {c: F.col("best")[c] for c in ("start", "length", "period")}
    milli = F.floor(1000 * top["length"] / top["period"])
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        *(c.alias(k) for k, c in top.items()),
        milli.cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
