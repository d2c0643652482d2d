"""Word shingles and min-max signatures of many texts at once, in numpy.

Words are runs of bytes that are no white space, with A-Z lower-cased; a shingle is five words in a row, or all words of
a text with fewer. Words and shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Permutations, each of which gives a minimum and a maximum; the chance that a pair at the threshold shares no band.
PERMUTATIONS, MISS = 75, 1e-5
#: Bytes that are hashed at once.
PIECE = 1 << 19

_random = np.random.default_rng(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = _random.integers(1, 1 << 63, 256).astype(np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_SPACE] = 0
_odd = lambda n: (_random.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE, _ORDER, _FACTORS, _BAND = _odd(1)[0], _odd(WORDS), _odd(PERMUTATIONS), _odd(2 * PERMUTATIONS)
_ADD = _odd(PERMUTATIONS)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word in the bytes; first: where the (non-empty) texts start."""
    space = _SPACE[data]
    before = np.empty_like(space)
    before[1:], before[0] = space[:-1], True
    before[first] = True
    starts = np.flatnonzero(~space & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tail = data[starts[0] :]
    place = np.arange(len(tail)) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(data))))
    length = int(place.max()) + 1
    hashes = np.add.reduceat(_VALUE[tail] * _power(length)[place], starts - starts[0])
    return mix(hashes), np.searchsorted(first, starts, "right") - 1


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts of any size, in pieces that end between words. data[first[i]:last[i]] are the texts, one after another."""
    full = np.flatnonzero(last > first)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, i = [], 0
    while i < len(full):
        start = first[full[i]]
        j = max(i + 1, int(np.searchsorted(last[full], start + PIECE, "right")))
        end = last[full[j - 1]]
        if end - start <= PIECE:
            hashes, text = _words(data[start:end], first[full[i:j]] - start)
            found.append((hashes, full[i:j][text]))
        else:  # one long text
            while start < end:
                stop = min(start + PIECE, end)
                while stop < end and not _SPACE[data[stop]]:
                    stop += 1
                hashes, _ = _words(data[start:stop], np.zeros(1, np.int64))
                found.append((hashes, np.full(len(hashes), full[i])))
                start = stop
        i = j
    return np.concatenate([h for h, _ in found]), np.concatenate([t for _, t in found])


def shingle_sets(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts, one text after another, and the n + 1 offsets of the texts in them."""
    words, text = word_hashes(data, first, last)
    n = len(first)
    count = np.bincount(text, minlength=n)
    begin = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        size = len(words)
        summed = np.zeros(size, np.uint64)
        for k in range(WORDS):
            summed[: size - k] += words[k:] * _ORDER[k] if size >= k else 0
        # In texts of fewer words all of them make one shingle, which also holds their number.
        for k in np.flatnonzero((count > 0) & (count < WORDS)):
            a, m = begin[k], count[k]
            summed[a] = (words[a : a + m] * _ORDER[:m]).sum() + np.uint64(m) * _BASE
        hashed = mix(summed)
    shingles = np.where(count < WORDS, np.minimum(count, 1), count - WORDS + 1)
    ends = np.cumsum(shingles)
    take = np.repeat(begin - (ends - shingles), shingles) + np.arange(ends[-1] if n else 0)
    flat = hashed[take] if len(take) else np.zeros(0, np.uint64)
    for a, b in zip((ends - shingles).tolist(), ends.tolist()):
        flat[a:b].sort()
    owner = np.repeat(np.arange(n), shingles)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], np.append(0, np.cumsum(np.bincount(owner[new], minlength=n)))


def signatures(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side, for each non-empty set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(starts), 2 * PERMUTATIONS), np.uint64)
    if len(starts):
        for k in range(PERMUTATIONS):
            permuted = flat * _FACTORS[k] + _ADD[k]
            permuted ^= permuted >> np.uint64(32)
            out[:, 2 * k] = np.minimum.reduceat(permuted, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(permuted, starts)
    return out


def band_rows(percent: int) -> int:
    """Values in a band: as many as find pairs of this similarity but for a chance of MISS."""
    values = 2 * PERMUTATIONS
    fits = [r for r in range(1, values + 1) if values % r == 0 and (1 - (percent / 100) ** r) ** (values // r) <= MISS]
    if not fits:
        raise ValueError(f"{values} values don't find pairs of similarity {percent} %")
    return max(fits)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many values; keys of different bands differ."""
    with np.errstate(over="ignore"):
        salted = mix(signature + _BAND) * _BAND
        return mix(salted.reshape(len(signature), 2 * PERMUTATIONS // rows, rows).sum(2, dtype=np.uint64)).view(np.int64)


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to PIECE bytes together, or one longer text."""
    ends, i, n = np.cumsum(sizes), 0, len(sizes)
    while i < n:
        start = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, start + PIECE, "right")))
        yield i, j
        i = j
