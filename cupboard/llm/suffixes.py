"""Content-defined runs of suffixes and their fingerprints: the arithmetic of ``repeats``."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Bytes that choose where runs are anchored; a repeated string holds at least one whole gram.
GRAM = 32
# Suffixes are hashed in buffers of at most this many bytes; an index fits the low bits of a sort key.
INDEX_BITS = 20
BUFFER = (1 << INDEX_BITS) - 1
BLOCK = 8  # suffixes per block of a run

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of every byte, powers of the base and of its inverse modulo 2^64."""
    values = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    powers = np.full(BUFFER + 1, _BASE, np.uint64)
    inverse = np.full(BUFFER + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return values, np.cumprod(powers), np.cumprod(inverse)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word (the finalizer of MurmurHash3)."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Hashes:
    """Hashes of all substrings of one buffer; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        values, self.powers, self.inverse = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * self.powers[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[begin + length] - self.sums[begin]) * self.inverse[begin] + np.asarray(length).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]


@dataclass
class Runs:
    """Runs of consecutive suffixes with one anchor: those that start ``low`` to ``high`` bytes before ``anchor``."""

    piece: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def find_runs(data: np.ndarray, begins: np.ndarray, depth: int) -> Runs:
    """Runs of all suffixes of at least ``depth`` bytes of the pieces that begin at ``begins`` in ``data``.

    The anchor of a suffix is the gram with the smallest hash (the first of equals) within its first ``depth``
    bytes. It depends on these bytes alone, so equal suffixes have equal anchors at equal distances.
    """
    n, grams = len(data), depth - GRAM + 1
    ends = np.append(begins[1:], n)
    empty = np.empty(0, np.int64)
    if n < depth:
        return Runs(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    hashes = Hashes(data)
    least = mix(hashes.every(GRAM)) >> _U(INDEX_BITS) << _U(INDEX_BITS)
    least |= np.arange(len(least), dtype=np.uint64)
    width = 1
    while width < grams:  # minimum over a window by doubling
        step = min(width, grams - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    anchors = (least & _U(BUFFER)).astype(np.int64)  # of every start up to n - depth
    # Starts whose first ``depth`` bytes stay inside their piece.
    lasts = ends - depth
    change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
    firsts = np.unique(np.concatenate([change, begins[begins < len(anchors)], np.clip(lasts + 1, 0, len(anchors))]))
    firsts = np.union1d(firsts[firsts < len(anchors)], [0])
    stops = np.append(firsts[1:], len(anchors))
    piece = np.searchsorted(begins, firsts, "right") - 1
    real = firsts <= lasts[piece]
    firsts, stops, piece = firsts[real], stops[real], piece[real]
    anchor = anchors[firsts]
    low, high = anchor - stops + 1, anchor - firsts
    whole = hashes.of(firsts, stops - 1 + depth - firsts) ^ mix((low << 16 | high).astype(np.uint64))
    return Runs(piece, anchor, low, high, hashes.of(anchor, GRAM), whole)


def pieces_of(texts: list[bytes], depth: int):
    """Buffers (data, begins, text numbers, offsets) that hold the texts whole; long ones overlap by ``depth - 1`` bytes."""
    held: list[bytes] = []
    number: list[int] = []
    offset: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - depth + 1), BUFFER // 2):
            part = text[at:at + BUFFER // 2 + depth - 1]
            if held and size + len(part) > BUFFER:
                yield _buffer(held, number, offset)
                held, number, offset, size = [], [], [], 0
            held.append(part)
            number.append(i)
            offset.append(at)
            size += len(part)
    if held:
        yield _buffer(held, number, offset)


def _buffer(held: list[bytes], number: list[int], offset: list[int]):
    begins = np.cumsum([0, *map(len, held[:-1])])
    return np.frombuffer(b"".join(held), np.uint8), begins, np.array(number), np.array(offset)


def runs_of(texts: list[bytes], depth: int) -> Runs:
    """Runs of all texts; ``piece`` is the number of the text and ``anchor`` a place in it."""
    found = []
    for data, begins, number, offset in pieces_of(texts, depth):
        r = find_runs(data, begins, depth)
        found.append(Runs(number[r.piece], r.anchor - begins[r.piece] + offset[r.piece], r.low, r.high, r.gram, r.whole))
    if not found:
        empty = np.empty(0, np.int64)
        return Runs(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    return Runs(*(np.concatenate([getattr(r, f) for r in found]) for f in Runs.__annotations__))


def within_text(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(first, twice): the first of equal runs of one text, and every run that its own text holds twice or more."""
    n = len(runs.piece)
    order = np.lexsort((runs.anchor, runs.gram, runs.whole, runs.piece))
    a, b = order[1:], order[:-1]
    same = (runs.piece[a] == runs.piece[b]) & (runs.whole[a] == runs.whole[b]) & (runs.gram[a] == runs.gram[b])
    first, twice = np.zeros(n, bool), np.zeros(n, bool)
    first[order] = np.concatenate([[True], ~same])[:n]
    twice[order] = np.concatenate([[False], same])[:n] | np.concatenate([same, [False]])[:n]
    return first, twice


def repeated_suffixes(bucket: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, segments: list[bytes],
                      depth: int, digit: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the spans that suffixes with an equal partner cover.

    Row i holds the bytes of the suffixes that start ``high[i]`` to ``low[i]`` before ``anchor[i]``. The suffixes are
    sorted by most significant digits: first by bucket and distance from the anchor, which equal suffixes share, then
    by ``digit`` bytes at a time up to ``depth``. After every pass groups of one drop out; what is left at the end
    are the repeated strings of ``depth`` bytes.
    """
    counts = high - low + 1
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)  # of a suffix in its segment
    edges = [*range(0, depth, digit), depth]
    digits = np.empty((len(edges) - 1, len(row)), np.uint64)
    at = 0
    while at < len(segments):  # as many segments as a buffer holds
        sizes = np.cumsum([len(s) for s in segments[at:at + BUFFER // depth]])
        n = max(1, int(np.searchsorted(sizes, BUFFER, "right")))
        hashes = Hashes(np.frombuffer(b"".join(segments[at:at + n]), np.uint8))
        begins = np.concatenate([[0], sizes[:n - 1]])
        mine = slice(*np.searchsorted(row, [at, at + n]))
        start = begins[row[mine] - at] + place[mine]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            digits[k, mine] = hashes.of(start + a, b - a)
        at += n
    distance = (high[row] - place).astype(np.uint64)
    group, alive = bucket[row].astype(np.uint64), np.arange(len(row))
    for values in (distance, *digits):
        order = np.lexsort((values[alive], group[alive]))
        alive = alive[order]
        g, v = group[alive], values[alive]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])[:len(alive)]
        group[alive] = np.cumsum(new).astype(np.uint64)
        single = new & np.concatenate([new[1:], [True]])[:len(alive)]
        alive = alive[~single]
    alive = np.sort(alive)
    fresh = np.concatenate([[True], alive[1:] != alive[:-1] + 1])[:len(alive)]
    fresh |= np.concatenate([[True], row[alive[1:]] != row[alive[:-1]]])[:len(alive)]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(alive))[:len(first)] - 1
    rows = row[alive[first]]
    base = anchor[rows] - high[rows]
    return rows, base + place[alive[first]], base + place[alive[last]] + depth
