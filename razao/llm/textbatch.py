"""Vectorised text primitives for one Arrow batch inside a Spark task.

A batch of texts is looked at as one byte buffer plus offsets, so that word
boundaries, word hashes and n-gram hashes of all its documents come out of a
handful of numpy passes.  Everything here is per-batch arithmetic; the work is
spread, shuffled and aggregated by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, hence invertible modulo 2**64
BASE_INV = pow(BASE, -1, 1 << 64)

#: bytes 0x20 and 0x09-0x0D separate words
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII lower case, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (grown by doubling, kept per worker)."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, dtype=U64)
    while len(have) < n + 1:
        step = U64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from 64-bit hashes."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class PrefixHash:
    """Prefix polynomial hashes of a byte buffer: any substring in O(1)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * _geometric(BASE, n)[:n], out=self.prefix[1:])
        self.inverse = _geometric(BASE_INV, n)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """Mixed hash of data[start:end], length included."""
        return mix(self.raw(start, end) ^ ((end - start).astype(U64) << U64(40)), seed)


class Texts:
    """A run of documents of one batch as a byte buffer and offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data = data
        self.offsets = offsets
        self.first = first
        self.n = len(offsets) - 1

    def words(self, data: np.ndarray | None = None,
              space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every run of bytes that ``space`` leaves."""
        data = self.data if data is None else data
        starts, ends = runs(~space[data], self.offsets)
        return starts, ends, self.doc_of(starts)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, side="right") - 1


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a document boundary."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[Texts]:
    """The texts of a batch in runs of at most ``most`` bytes (one text at least).

    A null text is an empty one.  ``first`` is the row of the run's first text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column, b"").cast(pa.large_binary())
    else:
        column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        upto = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        upto = min(max(upto, row + 1), len(column))
        own = offsets[row: upto + 1]
        yield Texts(raw[own[0]: own[-1]], own - own[0], row)
        row = upto


def per_doc(values: np.ndarray | None, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum (or count) by document."""
    if values is None:
        return np.bincount(doc, minlength=n).astype(np.int64)
    return np.bincount(doc, weights=values, minlength=n)


def repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: is (doc, key) found twice or more; is it not the first."""
    again = np.zeros(len(key), dtype=bool)
    later = np.zeros(len(key), dtype=bool)
    if len(key) < 2:
        return again, later
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    later[order[1:][same]] = True  # lexsort is stable: the first stays in front
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later
