"""Arrays of one task packed into one compressed binary cell.

Some operators move millions of small fixed-width entries.  A row per entry
would cost several times its payload, so a task sends one row per destination
bucket with the entries as packed arrays; Spark shuffles the rows by bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class _Codecs(dict):
    """Codecs of this process: they can't be pickled, so functions that use them travel without."""

    def __reduce__(self):
        return _Codecs, ()


_codec = _Codecs()


def _zstd() -> pa.Codec:
    if "zstd" not in _codec:
        _codec["zstd"] = pa.Codec("zstd", compression_level=1)
    return _codec["zstd"]


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of the arrays, compressed: equal high bytes cost nothing."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros(0, np.uint8)
        parts.append(np.array([len(a)], np.int64).tobytes() + np.ascontiguousarray(planes).tobytes())
    raw = b"".join(parts)
    return np.array([len(raw)], np.int64).tobytes() + _zstd().compress(raw, asbytes=True)


def unpack(cell: bytes, *dtypes: str) -> list[np.ndarray]:
    size = int(np.frombuffer(cell, np.int64, 1)[0])
    raw = _zstd().decompress(cell[8:], size, asbytes=True)
    out, at = [], 0
    for d in map(np.dtype, dtypes):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        at += 8
        planes = np.frombuffer(raw, np.uint8, n * d.itemsize, at).reshape(d.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(d).ravel() if n else np.zeros(0, d))
        at += n * d.itemsize
    return out


def joined(cells, *dtypes: str) -> list[np.ndarray]:
    parts = [unpack(c, *dtypes) for c in cells]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, d) for i, d in enumerate(dtypes)]


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values of a sorted array, and the end of all."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return new, np.append(new, len(key))
