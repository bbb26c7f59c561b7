"""Hashed n-gram features of a batch and their corpus-wide histograms.

Tokens are runs of letters, digits and non-ASCII bytes, or runs of other
visible ASCII characters.  Features are the unigrams and the bigrams inside a
document, hashed into ``buckets`` cells; a token that follows itself counts as
the one bigram REPEAT, so that loops of any word share a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import SPACE, U64, PrefixHash, Texts, mix, runs, slices

#: cells of the hashed n-gram models; a model is two vectors of this length
BUCKETS = 10_000

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
_PUNCT = ~_ALNUM & ~SPACE
_PUNCT[:32] = False


def features(texts: Texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each unigram and bigram, in no given order."""
    a, b = runs(_ALNUM[texts.data], texts.offsets)
    c, d = runs(_PUNCT[texts.data], texts.offsets)
    start, end = np.concatenate([a, c]), np.concatenate([b, d])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    word = PrefixHash(texts.data).of(start, end)
    doc = texts.doc_of(start)
    inside = doc[1:] == doc[:-1]
    left, right = word[:-1][inside], word[1:][inside]
    pair = np.where(left == right, U64(1), mix(left * U64(3) + right, 7))
    cell = np.concatenate([word, pair]) % U64(buckets)
    return cell.astype(np.int64), np.concatenate([doc, doc[1:][inside]])


def histogram(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, raw, target)`` over all rows of ``docs(text, trusted)``.

    Every task sums its rows into one vector of ``buckets`` cells and passes on
    the cells in use; the final sum is a grouped aggregate with map-side combine.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(buckets, np.int64)
        target = np.zeros(buckets, np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False), bool)
            for texts in slices(batch.column("text")):
                cell, doc = features(texts, buckets)
                raw += np.bincount(cell, minlength=buckets)
                if trusted[texts.first: texts.first + texts.n].any():
                    target += np.bincount(cell[trusted[texts.first + doc]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    return (docs.select("text", "trusted")
            .mapInArrow(count, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def holders(docs: DataFrame, buckets: int) -> DataFrame:
    """As ``histogram``, with the number of documents that hold a cell; bucket -1 has all documents with text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(buckets + 1, np.int64)
        target = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column("trusted").to_numpy(zero_copy_only=False), bool)
            for texts in slices(batch.column("text")):
                cell, doc = features(texts, buckets)
                both = np.unique(np.concatenate([doc * (buckets + 1) + cell + 1, np.unique(doc) * (buckets + 1)]))
                doc, cell = both // (buckets + 1), both % (buckets + 1)
                raw += np.bincount(cell, minlength=buckets + 1)
                target += np.bincount(cell[trusted[texts.first + doc]], minlength=buckets + 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used - 1), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    return (docs.select("text", "trusted")
            .mapInArrow(count, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def strongest(column: pa.Array, value: np.ndarray) -> np.ndarray:
    """The largest value of a row's n-grams; NaN without any."""
    top = np.full(len(column), -np.inf)
    for texts in slices(column):
        cell, doc = features(texts, len(value))
        np.maximum.at(top, texts.first + doc, value[cell])
    return np.where(np.isinf(top), np.nan, top)


def log_ratio(counts: DataFrame, buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """log p_target(cell) - log p_raw(cell), additive smoothing.

    The driver receives at most ``buckets`` rows, whatever the corpus size.
    """
    raw = np.zeros(buckets)
    target = np.zeros(buckets)
    for r in counts.collect():
        raw[r["bucket"]] = r["raw"]
        target[r["bucket"]] = r["target"]
    if not target.sum():
        return np.zeros(buckets)
    return (np.log((target + smooth) / (target.sum() + smooth * buckets))
            - np.log((raw + smooth) / (raw.sum() + smooth * buckets)))


def scores(column: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log ratios and number of n-grams, per row of the batch."""
    total = np.zeros(len(column))
    n = np.zeros(len(column), np.int64)
    for texts in slices(column):
        cell, doc = features(texts, len(ratio))
        rows = slice(texts.first, texts.first + texts.n)
        total[rows] = np.bincount(doc, weights=ratio[cell], minlength=texts.n)
        n[rows] = np.bincount(doc, minlength=texts.n)
    return total, n
