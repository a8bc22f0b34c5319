"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the byte-level pattern of the vocabulary; each
piece starts as one symbol per UTF-8 byte, kept in a linked list, and the
adjacent pair of lowest rank (then leftmost) is popped from a heap and merged
until none is left. The count is initial symbols minus merges; no identifiers
are made. Counts of pieces are kept in a bounded per-worker table.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special
string inside a text counts as one token and splits the text, as in the
library's default; repeated rows give repeated rows; other columns of the input are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .textops import mix, span_hashes

#: Pieces remembered by a worker (about 100 bytes each); the table is emptied when full.
PIECE_CACHE = 400_000
#: Characters handled at once.
SLICE_CHARS = 1_500_000
LETTER, NUMBER, SPACE = 1, 2, 3
#: Unicode White_Space; fixed values.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16.0 added and the library knows; Python's own table may be older. Fixed values.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Endings that are pieces of their own after an apostrophe; fixed values of the public pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_kinds() -> np.ndarray:
    """Letter, number, white space or other (0) for each code point."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in ranges:
            kinds[a : b + 1] = kind
    kinds[list(WHITE_SPACE)] = SPACE
    return kinds


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Ranks of the pairs of a byte-level BPE file in the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.byte = [vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.seen: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            if len(self.seen) >= PIECE_CACHE:
                self.seen.clear()
            n = self.merged(piece.encode())
            if len(piece) <= 64:
                self.seen[piece] = n
        return n

    def merged(self, data: bytes) -> int:
        """Symbols left of ``data`` when no pair can be merged any more."""
        rank, made, byte = self.rank, self.made, self.byte
        sym = [byte[b] for b in data]
        n = size = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n or rank.get(sym[i] << 32 | sym[j]) != r:
                continue  # one of the two was merged since
            sym[i], sym[j] = made[r], -1
            size -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(heap, s << 32 | i)
            if (h := before[i]) >= 0 and (s := rank.get(sym[h] << 32 | sym[i])) is not None:
                heapq.heappush(heap, s << 32 | h)
        return size


@lru_cache(4)
def load(path: str) -> Merges:
    return Merges(path)


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point; ``first``: where texts begin."""
    kind = char_kinds()[cp]
    n = len(cp)
    new = np.zeros(n + 1, bool)
    new[first] = True
    new[n] = True
    start = new[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before a word is a piece of its own, or joins the word if it is a blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~new[1:n])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    for i in np.flatnonzero((cp == 39) & start):
        for e in ENDINGS:
            stop = i + 1 + len(e)
            if stop <= n and not new[i + 1 : stop].any() and "".join(map(chr, cp[i + 1 : stop])) == e:
                start[i + 1 : stop] = False
                if stop < n:
                    start[stop] = True
                break
    return start


def count_texts(texts: list[str], merges: Merges) -> np.ndarray:
    """Tokens of each text."""
    total = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    for row, text in enumerate(texts):
        pieces = [text]
        for s in merges.specials:
            if s in text:
                pieces = [y for x in pieces for y in x.split(s)]
                total[row] += text.count(s)
        for x in pieces:
            if x:
                parts.append(x)
                owner.append(row)
    lo = 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= SLICE_CHARS):
            size += len(parts[hi])
            hi += 1
        total += np.bincount(*_slice(parts[lo:hi], owner[lo:hi], merges), minlength=len(texts)).astype(np.int64)
        lo = hi
    return total


def _slice(parts: list[str], owner: list[int], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    whole = "".join(parts)
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(x) for x in parts])
    first = np.cumsum(sizes) - sizes
    start = np.flatnonzero(piece_starts(cp, first))
    end = np.append(start[1:], len(cp))
    h = span_hashes(mix(cp.astype(np.uint64) + np.uint64(1)), start, end)
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    count = merges.count
    counts = np.fromiter((count(whole[a:b]) for a, b in zip(start[where].tolist(), end[where].tolist())), np.float64, len(where))
    rows = np.asarray(owner)[np.searchsorted(first, start, "right") - 1]
    return rows, counts[which]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        merges = load(path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n = count_texts(texts, merges)
        size = np.array([len(x.encode()) for x in texts], np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
