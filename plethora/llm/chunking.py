"""Content-defined chunks of byte strings, in numpy: normalised gear-hash boundaries and a digest per chunk.

The gear hash of a place sums the table values of the last eight bytes, each shifted by four more bits than the one after
it, so it forgets older bytes by itself; doubling steps give it for all places at once. From a chunk's start, the first
place beyond MIN whose hash passes the strict mask ends the chunk; from NORMAL on the loose mask is enough, and MAX ends
it anyway. An insertion moves only the boundaries near it.
"""

from __future__ import annotations

import numpy as np

from plethora.llm.shingles import mix

#: Bytes. MIN covers the hash's memory, so no boundary depends on what stands before a text.
MIN, NORMAL, MAX = 8, 20, 64
STRICT, LOOSE = 6, 3

_random = np.random.default_rng(20)
_GEAR = _random.integers(0, 1 << 32, 256, np.uint32)
_VALUE = _random.integers(1, 1 << 63, 256).astype(np.uint64)
_PLACE = (_random.integers(1, 1 << 62, MAX).astype(np.uint64) << np.uint64(1)) + np.uint64(1)


def gear(data: np.ndarray) -> np.ndarray:
    h = _GEAR[data]
    for step, shift in ((1, 4), (2, 8), (4, 16)):
        older = h[:-step] << np.uint32(shift)
        h = h.copy()
        h[step:] += older
    return h


def cuts(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks of all texts, in order, and the text of each; data[first[i]:last[i]] are the texts, one after another."""
    h = gear(data)
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    strict = loose[h[loose] < np.uint32(1 << (32 - STRICT))]
    loose, strict = np.append(loose, len(data) + MAX), np.append(strict, len(data) + MAX)
    text = np.flatnonzero(last > first)
    at, starts, owners = first[text], [], []
    while len(at):
        starts.append(at), owners.append(text)
        hard = strict[np.searchsorted(strict, at + (MIN - 1))] + 1
        soft = loose[np.searchsorted(loose, at + NORMAL)] + 1
        end = np.where(hard - at <= NORMAL, hard, np.minimum(soft, at + MAX))
        more = end < last[text]
        at, text = end[more], text[more]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, owners = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(starts, kind="stable")
    return starts[order], owners[order]


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted distinct chunks as uint64: 40 bits of digest, then 8 bits of length."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.cumsum(sizes)
    first = last - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, owner = cuts(data, first, last)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    length = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        digest = mix(np.add.reduceat(_VALUE[data] * _PLACE[place], starts) + length.astype(np.uint64))
    chunk = digest >> np.uint64(24) << np.uint64(8) | length.astype(np.uint64)
    order = np.lexsort((chunk, owner))
    chunk, owner = chunk[order], owner[order]
    new = np.append(True, (chunk[1:] != chunk[:-1]) | (owner[1:] != owner[:-1]))
    chunk, owner = chunk[new], owner[new]
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [chunk[a:b] for a, b in zip(at[:-1], at[1:])]


def containment(mine: np.ndarray, other: np.ndarray) -> float:
    """The share of my chunks' bytes that the other has too; two empty sets contain each other."""
    if not len(mine):
        return 1.0 if not len(other) else 0.0
    if not len(other):
        return 0.0
    at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
    length = (mine & np.uint64(255)).astype(np.int64)
    return float(length[other[at] == mine].sum() / length.sum())
