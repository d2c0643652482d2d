"""Static binary-fuse filters over 64-bit keys, in numpy.

A filter is a byte table; a key belongs to it if the xor of the three bytes at its places equals the key's own byte.
Places lie in three neighbouring segments, so construction peels almost surely at about 1.13 bytes a key, and every
member is found; a non-member passes with a chance of 1/256. Peeling goes in rounds: the keys that are alone at a
place leave together, and bytes are then set in reverse order of the rounds.
"""

from __future__ import annotations

import struct

import numpy as np

from plethora.llm.shingles import mix

_HEAD = struct.Struct("<QII")


def _places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Three places for each key, and the key's byte."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64)
        g = mix(h + np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(segment - 1)
    inner = [g & mask, (g >> np.uint64(18)) & mask, (g >> np.uint64(36)) & mask]
    at = np.stack([(first + k) * segment + inner[k].astype(np.int64) for k in range(3)])
    return at, (g >> np.uint64(56)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of distinct uint64 keys, as bytes."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    capacity = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
    seed = 0x243F6A8885A308D3
    for attempt in range(100):
        starts = max(1, -(-capacity // segment) - 2)
        size = (starts + 2) * segment
        at, own = _places(keys, seed, segment, starts)
        count = np.bincount(at.ravel(), minlength=size)
        summed = np.zeros(size, np.int64)
        for row in at:
            np.add.at(summed, row, np.arange(n))
        rounds, left = [], n
        single = np.flatnonzero(count == 1)
        while len(single):
            key, first = np.unique(summed[single], return_index=True)
            rounds.append((key, single[first]))
            left -= len(key)
            touched = at[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.subtract.at(summed, row, key)
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if not left:
            break
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
        capacity += capacity // 50 + 1
    else:
        raise ValueError("the filter can't be built")
    cells = np.zeros(size, np.uint8)
    for key, place in reversed(rounds):
        cells[place] = own[key] ^ cells[at[0, key]] ^ cells[at[1, key]] ^ cells[at[2, key]]  # the place itself still holds 0
    return _HEAD.pack(seed, segment, starts) + cells.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, starts = _HEAD.unpack_from(blob)
    cells = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    at, own = _places(keys.astype(np.uint64), seed, segment, starts)
    return (cells[at[0]] ^ cells[at[1]] ^ cells[at[2]]) == own
