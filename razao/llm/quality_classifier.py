"""Quality classifier by importance resampling.

A document's log importance weight is the log ratio of two hashed n-gram
generative models, target (trusted documents) over raw (all documents).  The
sum over its n-grams is tempered to ``reference`` n-grams, so that a long
document is not decided by the sheer number of small deviations.  Gumbel noise
derived from the id and a seed is added, and the k documents with the largest
keys are drawn (Gumbel top-k: sampling without replacement in proportion to
the weights).  Unless k is given, it is the number of documents whose key
exceeds the cut calibrated on held-out labelled documents, so that the draw
rejects what the target model rejects and keeps clean documents.  Documents
that ``labelled.toxicity`` rejects are not drawn.

Defined results: an empty or null text has log weight 0; a null id draws its
noise from 0; documents that tie at the k-th key are all drawn; without labels
every weight is 0 and all documents are drawn (k given: k by noise alone).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, ngrams
from .tables import documents, stored
from .textbatch import U64, mix, unit

#: a document's weight is that of so many of its n-grams
REFERENCE = 100
SEED = 20240607
#: cells a round of the k-th key search
FANOUT = 4096


def _keys(column_id: pa.Array, text: pa.Array, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    total, n = ngrams.scores(text, ratio)
    weight = total / np.maximum(n, 1) * REFERENCE
    ids = column_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    noise = -np.log(-np.log(unit(mix(mix(ids, 1) + U64(seed), 2))))
    return weight, weight + noise


def weights(docs: DataFrame, ratio: np.ndarray, toxic: tuple[np.ndarray, float], seed: int = SEED) -> DataFrame:
    """``(doc_id, log_weight, gumbel_key, mild)`` of every document; no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, key = _keys(batch.column("doc_id"), batch.column("text"), ratio, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(weight), pa.array(key),
                 pa.array(labelled.mild(batch.column("text"), toxic))],
                ["doc_id", "log_weight", "gumbel_key", "mild"])

    return documents(docs).mapInArrow(score, "doc_id long, log_weight double, gumbel_key double, mild boolean")


def kth_largest(scored: DataFrame, k: int, col: str = "gumbel_key") -> float:
    """The k-th largest value of ``col``: histograms that narrow, no sort.

    Each round counts FANOUT cells (all the driver sees) and goes on inside
    the cell that holds the k-th value.
    """
    lo, hi, n = scored.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or lo is None:
        return math.inf
    if k >= n:
        return -math.inf
    above = 0  # values over hi
    while lo < hi:
        step = (hi - lo) / FANOUT
        if not lo < lo + step < hi:
            break
        cell = F.least(F.floor((F.col(col) - lo) / step), F.lit(FANOUT - 1))
        rows = (scored.where(F.col(col).between(lo, hi)).groupBy(cell.alias("cell"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
                .collect())
        for r in sorted(rows, key=lambda r: -r["cell"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
        if above + 1 == k:
            return hi
    return lo


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None,
             buckets: int = ngrams.BUCKETS, seed: int = SEED,
             most_labels: int = labelled.MOST_LABELS) -> tuple[DataFrame, np.ndarray, tuple, float]:
    """Scored documents (stored), both models and the key from which on the mild ones are drawn."""
    ratio, cut = labelled.model(docs, labels, buckets, most_labels)
    toxic = labelled.toxicity(docs, labels, most=most_labels)
    scored = stored(weights(docs, ratio, toxic, seed), "gumbel")
    mild = scored.where("mild")
    if k is None:
        k = mild.where(F.col("gumbel_key") >= F.lit(float(cut * REFERENCE))).count() \
            if math.isfinite(cut) else mild.count()
    return scored, ratio, toxic, kth_largest(mild, k)


def quality_classifier(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """``(doc_id, log_weight, gumbel_key, kept)`` for every document."""
    scored, _, _, least = resample(docs, labels, k, **options)
    return scored.select("doc_id", "log_weight", "gumbel_key",
                         (F.col("mild") & (F.col("gumbel_key") >= F.lit(float(least)))).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The drawn documents with all columns of the input.

    The key is a function of a row alone, so it is computed again where the
    row is instead of joining the verdicts to the texts.
    """
    _, ratio, toxic, least = resample(docs, labels, k, seed=seed)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key = _keys(batch.column("doc_id").cast(pa.int64()), batch.column("text"), ratio, seed)
            yield batch.filter(pa.array((key >= least) & labelled.mild(batch.column("text"), toxic)))

    return docs.select(*names).mapInArrow(keep, docs.schema)
