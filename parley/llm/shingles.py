"""Word shingles of texts as sets of 64-bit numbers, and keys that similar sets share."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import xxhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_DEEPEST = 12
_MOST_PARITIES = 1 << 15
_LARGEST = 1 << 40


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, table: bytes = LOWER) -> np.ndarray:
    """Words are the runs of other bytes between ASCII white space; ``table`` translates bytes first."""
    words = text.translate(table).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, one for each place where a run begins."""
    n = max(len(h) - size + 1, 0)
    s = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        s = mix(s * _A + h[k : n + k])
    return s


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words, sorted; a shorter text is one shingle, no words are none."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(shingle_hashes(h, min(size, len(h))))


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls on each of the cells, in words of 64 bits; at most two cells an element.

    Each element in only one of two sets changes one parity, so two sets differ in as many elements as parities at least.
    """
    cells = 64
    while cells < min(len(s), _MOST_PARITIES):
        cells *= 2
    place = (mix(s + _B) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=cells) & 1).astype(bool), bitorder="little").view(np.uint64)


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities as they are for so many words of cells: the upper half falls on the lower."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def most_differing(largest: int, threshold: Fraction) -> int:
    """How many elements can be in only one of two sets of at most ``largest`` with this similarity."""
    return int(2 * largest * (1 - threshold) / (1 + threshold))


@lru_cache
def size_classes(largest: int) -> tuple[int, ...]:
    """Upper ends of the size classes, each half as large again as the last."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return tuple(ends)


def _cells(s: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the elements that a seeded hash deals to each of the cells."""
    place = (mix(s ^ mix(np.array([seed], dtype=np.uint64))) % np.uint64(cells)).astype(np.int64)
    sums = np.zeros(cells, dtype=np.uint64)
    np.add.at(sums, place, mix(s + _C))
    return sums, np.bincount(place, minlength=cells)


def class_cells(k: int, ends: tuple[int, ...], threshold: Fraction) -> tuple[int, int]:
    """Cells of size class ``k``, and how many of them may be empty.

    Two similar sets differ in so many elements at most, hence in so many cells. One cell more is equal in both,
    and as many again as may be empty leave an equal one with something in it.
    """
    least = int((ends[k - 1] + 1) * threshold) if k else 1
    differing, spare = most_differing(ends[k], threshold), 0
    for _ in range(3):
        cells = differing + 1 + spare
        expected = cells * math.exp(-least / cells)
        spare = math.ceil(expected + 5 * math.sqrt(expected)) if expected > 0.05 else 0
    return differing + 1 + spare, spare


def _keys(s: np.ndarray, cells: int, spare: int, seed: int, depth: int = 0) -> list[np.ndarray]:
    sums, counts = _cells(s, cells, seed)
    names = mix(np.arange(cells, dtype=np.uint64) + np.array([seed], dtype=np.uint64) * _A)
    keys = mix(sums ^ names)
    empty = np.flatnonzero(counts == 0)
    if depth == _DEEPEST:
        return [keys]
    found = [keys[counts > 0]]
    if len(empty) > spare:
        # Too many sets have the same empty cells: each such cell is dealt out again, by another hash.
        for cell in empty.tolist():
            found += _keys(s, cells, spare, int(names[cell] >> np.uint64(1)), depth + 1)
    return found


@lru_cache(maxsize=4096)
def _plan(k: int, threshold: Fraction) -> tuple[int, int]:
    return class_cells(k, size_classes(_LARGEST), threshold)


def shared_keys(s: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Keys of a set; two sets of similarity ``threshold`` or more have one in common, whatever they hold.

    Elements are dealt to more cells than can differ between two such sets of a size class, so one with elements is equal
    in both, and a key names a cell's content. A set near the end of its class also
    gives the keys of the next, where larger sets may resemble it.
    """
    n = len(s)
    if not n:
        return np.zeros(0, dtype=np.int64)
    ends = size_classes(_LARGEST)
    k = int(np.searchsorted(ends, n))
    wanted = [k, k + 1] if Fraction(n, ends[k] + 1) >= threshold else [k]
    found = []
    for c in wanted:
        found += _keys(s, *_plan(c, threshold), c + 1)
    return np.unique(np.concatenate(found)).view(np.int64)


def bands_for(threshold: float, recall: float, most_hashes: int = 48) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands find a pair at the threshold with the wanted probability."""
    best = (1, 1)
    for rows in range(1, most_hashes):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall:
            bands += 1
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def minhash_keys(sets: list[np.ndarray], bands: int, rows: int, seed: int = 42) -> np.ndarray:
    """One key per band of every non-empty set, as a table of sets by bands."""
    keys = np.zeros((len(sets), bands), dtype=np.uint64)
    if not sets:
        return keys.view(np.int64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k in range(bands * rows):
        salt = mix(np.array([seed * 1000 + k], dtype=np.uint64))
        smallest = np.minimum.reduceat((flat ^ salt) * (salt | np.uint64(1)), starts)
        band = k // rows
        keys[:, band] = mix(keys[:, band] * _A + smallest + np.uint64(band + 1))
    return keys.view(np.int64)
