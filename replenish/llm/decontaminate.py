"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts are sequences of words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased). An
item of m words is found in a document where some run of words is within
d = floor((1 - similarity) * m) word edits (insert, delete, replace) of it.

1. Windows. An item within d edits keeps one of d+1 equal pieces of the item
   unchanged, so only windows that start around a place where the first words
   of a piece occur can hold it; no match is lost here.
2. CGK random walk. A window of m words is embedded into 3m symbols: at step j
   the walk emits the word under it and moves on by a random bit of (step,
   word). Few edits between two windows then become few differing symbols.
3. Bit sampling. Each of L tables has a walk of its own and samples a few
   embedding coordinates as its bucket key; a window is a candidate if it meets the
   item in a bucket of any table. L follows from the collision rate measured
   on items with d random edits, by length class, and the target recall; where the
   most tables do not reach it, all windows of a class go on to the check.
4. Exact check. Bit-parallel edit distance of the item against the words around the
   window; the row holds the smallest distance and its run of words.

Items are handled in blocks of bounded size, each broadcast; documents are read
once a block. Defined results: null or empty documents and items match nothing; an
item with fewer than 5 words must occur unchanged; a document and an item give one row
(the run of least distance, then first), repeated rows of either one each;
other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .textops import grams, mix, text_slices, words

SIMILARITY = 0.8
RECALL = 0.99
COORDINATES = 2
#: Items broadcast at once (about 1 KB each); more items make more passes.
BLOCK_ITEMS = 20_000
MAX_TABLES = 64
#: Items of a length class whose recall is measured, and edited copies of them at least.
CLASS_PROBES, PROBES = 100, 600
U = np.uint64


class Item(NamedTuple):
    id: int
    hashes: np.ndarray
    edits: int


class Block(NamedTuple):
    items: list[Item]
    piece: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # words: hash (sorted), item, offset
    walks: np.ndarray  # tables x 3 * longest item, odd 64-bit values
    picks: np.ndarray  # tables x coordinates, in [0, 1)
    keys: np.ndarray  # items x tables
    direct: np.ndarray  # items whose windows are all verified


def embed_keys(windows: np.ndarray, sizes: np.ndarray, walks: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """LSH key of each window (rows padded to one width) in each table."""
    n, width = windows.shape
    tables = walks.shape[0]
    at = np.zeros((tables, n), np.int64)
    key = np.zeros((tables, n), np.uint64)
    coordinate = np.floor(picks[:, :, None] * (3 * sizes)[None, None, :]).astype(np.int64)
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    each = np.arange(n)[None, :]
    for j in range(int(coordinate.max()) + 1 if n else 0):
        word = padded[each, np.minimum(at, sizes[None, :])]
        word = np.where(at < sizes[None, :], word, U(0))
        for c in range(picks.shape[1]):
            hit = coordinate[:, c, :] == j
            if hit.any():
                key = np.where(hit, mix(key * U(0x9E3779B97F4A7C15) ^ word), key)
        at += ((word * walks[:, j][:, None]) >> U(63)).astype(np.int64)
    return key.T


def least_edits(item: np.ndarray, run: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the run part nearest to ``item``, if within ``limit``; bit-parallel."""
    best = _scan(item, run)
    if best is None or best[0] > limit:
        return None
    distance, end = best
    back = _scan(item[::-1], run[:end][::-1], anchored=True)
    return distance, end - back[1], end


def _scan(item: np.ndarray, run: np.ndarray, anchored: bool = False) -> tuple[int, int] | None:
    """Least distance of ``item`` to a part of ``run`` and where that part first ends; anchored: to a prefix."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        peq[w] = peq.get(w, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best = (m, 0)
    for end, w in enumerate(run.tolist(), 1):
        eq = peq.get(w, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(zero | plus) & ones
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | anchored) & ones
        down = down << 1 & ones
        plus = down | ~(zero | up) & ones
        minus = up & zero
        if score < best[0]:
            best = (score, end)
    return best


def allowed_edits(m: int, similarity: float) -> int:
    return math.floor((1 - similarity) * m + 1e-9)


def build(rows: list[tuple[int, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 11) -> Block | None:
    """The search structure of one block of items."""
    ids = [r[0] for r in rows]
    items: list[Item] = []
    for lo, hi, raw, at in text_slices(pa.array([r[1] for r in rows], pa.string())):
        w = words(raw, at)
        for i in range(hi - lo):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if len(h) and ids[lo + i] is not None:
                items.append(Item(ids[lo + i], h, allowed_edits(len(h), similarity)))
    if not items:
        return None
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, item in enumerate(items):
        m, pieces = len(item.hashes), item.edits + 1
        cuts = [m * p // pieces for p in range(pieces + 1)]
        size = min(4, min(b - a for a, b in zip(cuts, cuts[1:])))
        g, _ = grams(item.hashes, np.array([0, m]), size)
        found.setdefault(size, []).extend((int(g[a]), k, a) for a in cuts[:-1])
    piece = {}
    for size, x in found.items():
        x.sort()
        piece[size] = (np.array([y[0] for y in x], np.uint64), np.array([y[1] for y in x]), np.array([y[2] for y in x]))
    width = max(len(i.hashes) for i in items)
    rng = np.random.default_rng(seed)
    walks = rng.integers(1, 1 << 63, (MAX_TABLES, 3 * width), dtype=np.uint64) | U(1)
    picks = rng.random((MAX_TABLES, COORDINATES))
    sizes = np.array([len(i.hashes) for i in items])
    keys = embed_keys(_pad([i.hashes for i in items], width), sizes, walks, picks)
    tables, direct = _fitted(items, keys, walks, picks, recall, rng)
    return Block(items, piece, walks[:tables], picks[:tables], keys[:, :tables], direct)


def _pad(runs: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(runs), width), np.uint64)
    for i, r in enumerate(runs):
        out[i, : len(r)] = r[:width]
    return out


def length_class(sizes: np.ndarray) -> np.ndarray:
    """Items of 2**c to 2**(c + 1) - 1 words are class c."""
    return np.floor(np.log2(sizes)).astype(np.int64)


def _fitted(items: list[Item], keys: np.ndarray, walks: np.ndarray, picks: np.ndarray, recall: float, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """(tables, items to verify without them).

    Recall is measured a length class, on a hash-chosen sample of its items with
    their most edits; the class that needs most tables sets their number. Items of a class
    that all tables do not bring to the target have every piece window verified.
    """
    sizes = np.array([len(i.hashes) for i in items])
    classes = length_class(sizes)
    place = np.array([int(np.bitwise_xor.reduce(mix(i.hashes))) for i in items], np.uint64)
    tables, direct = 1, np.zeros(len(items), bool)
    for c in np.unique(classes).tolist():
        own = np.flatnonzero((classes == c) & np.array([i.edits > 0 for i in items]))
        if not len(own):
            continue
        probe = own[np.argsort(place[own], kind="stable")[:CLASS_PROBES]]
        width = int(sizes[probe].max())
        changed, owner = [], []
        for k in probe.tolist():
            for _ in range(max(3, -(-PROBES // len(probe)))):
                run = items[k].hashes.tolist()
                m = len(run)
                for _ in range(items[k].edits):
                    at, what = int(rng.integers(0, len(run))), int(rng.integers(0, 3))
                    run[at : at + (what != 1)] = [] if what == 0 else [int(rng.integers(1, 1 << 62))]
                run += rng.integers(1, 1 << 62, m).tolist()  # what follows in the document
                changed.append(np.array(run[:m], np.uint64))
                owner.append(k)
        met = embed_keys(_pad(changed, width), sizes[owner], walks, picks) == keys[owner]
        reached = np.logical_or.accumulate(met, axis=1).mean(axis=0)
        enough = np.flatnonzero(reached >= recall)
        if len(enough):
            tables = max(tables, int(enough[0]) + 1)
        else:
            direct[classes == c] = True
    return tables, direct


def search_slice(raw: np.ndarray, at: np.ndarray, block: Block) -> list[tuple[int, int, int, int, int]]:
    """(row, item index, distance, first word, end word) of the matches in a slice."""
    w = words(raw, at)
    row_of = w.row()
    starts: dict[tuple[int, int], set[int]] = {}
    for size, (known, item, offset) in block.piece.items():
        g, inside = grams(w.hash, w.first, size)
        sieve = np.zeros(1 << 16, bool)
        sieve[(known & U(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(sieve[(g & U(0xFFFF)).astype(np.int64)] & inside)
        lo, hi = np.searchsorted(known, g[maybe], "left"), np.searchsorted(known, g[maybe], "right")
        for p, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for e in range(a, b):
                starts.setdefault((int(row_of[p]), int(item[e])), set()).add(p - int(offset[e]))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    # First where a piece puts the item; unless it is there unchanged, also around it by up to its edits.
    for spread in (False, True):
        windows = []
        for key, places in starts.items():
            if key in best and best[key][0] == 0:
                continue
            d = block.items[key[1]].edits if spread else 0
            windows += [(key, s) for s in sorted({s + x for s in places for x in range(-d, d + 1)})]
        hits: dict[tuple[int, int], list[int]] = {}
        for lo in range(0, len(windows), 20_000):
            for key, s in _bucket_hits(windows[lo : lo + 20_000], w, block):
                hits.setdefault(key, []).append(s)
        for key, places in hits.items():
            if (got := _verified(key, places, w, block)) is not None and (key not in best or got < best[key]):
                best[key] = got
    return sorted((*key, *got) for key, got in best.items())


def _bucket_hits(part: list[tuple[tuple[int, int], int]], w, block: Block) -> list[tuple[tuple[int, int], int]]:
    runs, kept = [], []
    for (row, k), s in part:
        a, b = int(w.first[row]), int(w.first[row + 1])
        m = len(block.items[k].hashes)
        if s + m <= a or s >= b:
            continue
        s = max(s, a)
        runs.append(w.hash[s : min(b, s + m)])
        kept.append(((row, k), s))
    if not runs:
        return []
    of = np.array([key[1] for key, _ in kept])
    sizes = np.array([len(block.items[k].hashes) for k in of])
    keys = embed_keys(_pad(runs, int(sizes.max())), sizes, block.walks, block.picks)
    met = (keys == block.keys[of]).any(axis=1) | block.direct[of]
    return [kept[i] for i in np.flatnonzero(met)]


def _verified(key: tuple[int, int], several: list[int], w, block: Block) -> tuple[int, int, int] | None:
    row, k = key
    item = block.items[k]
    a, b = int(w.first[row]), int(w.first[row + 1])
    best = None
    several = sorted(set(several))
    lo = 0
    while lo < len(several):  # windows whose surroundings overlap are checked together
        hi = lo + 1
        reach = len(item.hashes) + 2 * item.edits
        while hi < len(several) and several[hi] - several[hi - 1] <= reach:
            hi += 1
        x, y = max(a, several[lo] - item.edits), min(b, several[hi - 1] + reach)
        got = least_edits(item.hashes, w.hash[x:y], item.edits)
        if got is not None and (best is None or got[0] < best[0]):
            best = (got[0], x - a + got[1], x - a + got[2])
        lo = hi
    return best


def blocks(benchmark: DataFrame, item_col: str, text_col: str, similarity: float):
    """Search structures of the items, at most BLOCK_ITEMS each."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).distinct()
    n = items.count()
    parts = max(1, math.ceil(n / (BLOCK_ITEMS / 2)))
    for p in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        rows = sorted(((r.i, r.t) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        if (block := build(rows, similarity)) is not None:
            yield block


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edits, n_words, first_word, end_word): benchmark items found in documents."""
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[id_col]}, item_id {item_kind}, edits int, n_words int, first_word int, end_word int"
    out: DataFrame | None = None
    for block in blocks(benchmark, item_col, item_text, similarity):
        shared = spark.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            block = shared.value
            got = []
            for lo, _, raw, at in text_slices(batch.column(1)):
                got += [(lo + r, *x) for r, *x in search_slice(raw, at, block)]
            if not got:
                return None
            i32 = pa.int32()
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([g[0] for g in got])),
                    pa.array([block.items[g[1]].id for g in got]),
                    pa.array([g[2] for g in got], i32),
                    pa.array([len(block.items[g[1]].hashes) for g in got], i32),
                    pa.array([g[3] for g in got], i32),
                    pa.array([g[4] for g in got], i32),
                ],
                names=["doc_id", "item_id", "edits", "n_words", "first_word", "end_word"],
            )

        part = map_batches(docs.select(id_col, text_col), run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
