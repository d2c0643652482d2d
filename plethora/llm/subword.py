"""Hashed subword embeddings, averaged over a bag, under a linear softmax; trained and applied in numpy.

A bag's class scores are W^T mean(E[g] for g in its subwords) + bias. E and W are trained jointly by minibatch stochastic
gradient descent. Once trained, E @ W is one small table, so applying the model is a sum of table rows over a text's
byte n-grams, in time and memory linear in the bytes at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once; longer texts are cut at multiples of it from their start.
PIECE = 1 << 19

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c >= 128:
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def fold(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and capitals of Latin-1 lower-cased, and ASCII other than letters and digits as spaces."""
    out = _FOLD[raw]
    if len(raw) > 1:
        capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        out[capital] += 32
    return out


def grams(folded: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram that starts at each place); near the end, n-grams run into zeros."""
    padded = np.concatenate([folded, np.zeros(max(orders), np.uint8)])
    n, h = len(folded), np.zeros(len(folded), np.uint32)
    for k in range(max(orders)):
        h *= np.uint32(0x01000193)
        h += padded[k : k + n]
        h += np.uint32(1)
        if k + 1 in orders:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield k + 1, (mixed >> np.uint32(32 - bits)).astype(np.int32)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the n + 1 offsets of its texts; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, first bytes of the pieces in it, their texts): runs of whole texts of up to PIECE bytes, or a piece of a longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        start = offsets[i]
        if offsets[i + 1] - start > PIECE:
            for a in range(start, offsets[i + 1], PIECE):
                yield a, min(a + PIECE, offsets[i + 1]), np.array([a]), np.array([i])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, start + PIECE, "right")) - 1)
        texts = np.arange(i, j)
        texts = texts[offsets[i + 1 : j + 1] > offsets[i:j]]
        if len(texts):
            yield start, offsets[j], offsets[texts], texts
        i = j


class BagModel:
    def __init__(self, classes: int, bits: int, dim: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.classes, self.bits, self.dim, self.random = classes, bits, dim, random
        self.embedding = (random.random(((1 << bits) + 1, dim), np.float32) - 0.5) / dim
        self.embedding[-1] = 0  # the row of places that hold no n-gram
        self.weights = (random.standard_normal((dim, classes)) * 0.1).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)
        self._squares = np.full_like(self.embedding, 1e-8), np.full_like(self.weights, 1e-8), np.full_like(self.bias, 1e-8)

    def table(self) -> np.ndarray:
        return (self.embedding @ self.weights).astype(np.float32)

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        size = np.diff(np.append(starts, len(ids)))[:, None]
        return np.add.reduceat(self.table()[ids], starts) / size + self.bias

    def fit(self, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, weight: np.ndarray, epochs: int, batch: int, rate: float = 0.1, decay: float = 1e-6) -> None:
        """Bags are ids[starts[i]:starts[i + 1]], none empty."""
        ends = np.append(starts[1:], len(ids))

        def take(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = ends[rows] - starts[rows]
            return ids[np.repeat(starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())], size

        self.fit_bags(take, labels, weight, epochs, batch, rate, decay)

    def fit_bags(self, take: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, epochs: int, batch: int, rate: float = 0.1, decay: float = 1e-6) -> None:
        """take: the ids of the bags with these numbers, one bag after another, and the bags' sizes; none is empty. Steps are scaled by AdaGrad."""
        for _ in range(epochs):
            order = self.random.permutation(len(labels))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                own, size = take(rows)
                first = np.cumsum(size) - size
                mean = np.add.reduceat(self.embedding[own], first) / size[:, None].astype(np.float32)
                score = mean @ self.weights + self.bias
                p = np.exp(score - score.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), labels[rows]] -= 1
                p *= (weight[rows] / weight[rows].sum())[:, None]
                back = (p @ self.weights.T) / size[:, None].astype(np.float32)
                touched, place = np.unique(own, return_inverse=True)
                spread = np.repeat(back, size, 0)
                grad = np.stack([np.bincount(place, spread[:, k], len(touched)) for k in range(self.dim)], 1).astype(np.float32)
                self._step(self.weights, mean.T @ p + decay * self.weights, self._squares[1], rate, slice(None))
                self._step(self.bias, p.sum(0), self._squares[2], rate, slice(None))
                self._step(self.embedding, grad + decay * self.embedding[touched], self._squares[0], rate, touched)
            self.embedding[-1] = 0

    def fit_counts(self, counts: Callable[[np.ndarray], np.ndarray], labels: np.ndarray, weight: np.ndarray, epochs: int, batch: int, rate: float = 0.1, decay: float = 1e-6) -> None:
        """The same steps from counts(rows): a row per bag, a column per id, how often the bag holds it. Sums over a bag are matrix products, which pays where bags are long."""
        for _ in range(epochs):
            order = self.random.permutation(len(labels))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                held = counts(rows)
                held /= held.sum(1, keepdims=True)
                mean = held @ self.embedding
                p = softmax(mean @ self.weights + self.bias)
                p[np.arange(len(rows)), labels[rows]] -= 1
                p *= (weight[rows] / weight[rows].sum())[:, None]
                touched = np.flatnonzero(held.any(0))
                grad = held[:, touched].T @ (p @ self.weights.T)
                self._step(self.weights, mean.T @ p + decay * self.weights, self._squares[1], rate, slice(None))
                self._step(self.bias, p.sum(0), self._squares[2], rate, slice(None))
                self._step(self.embedding, grad + decay * self.embedding[touched], self._squares[0], rate, touched)

    @staticmethod
    def _step(value: np.ndarray, grad: np.ndarray, squares: np.ndarray, rate: float, at) -> None:
        squares[at] += grad * grad
        value[at] -= rate * grad / np.sqrt(squares[at])


def softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)
