"""A bounded sample of trusted documents, and the cut that separates all labelled ones."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .tables import documents

#: most labelled documents used to fit a classifier; the cut takes all held-out ones
MOST_LABELS = 20_000
#: cells of the toxic evidence: so many that a long document fills few of them
TOXIC_BUCKETS = 1 << 18
#: score histogram: cells a unit of mean log ratio
CELLS = 1000
#: a trusted document under the cut weighs as many untrusted ones over it
GOOD_WEIGHT = 5.0


def roles(labels: DataFrame, seed: int = 7) -> DataFrame:
    """``(doc_id, role, h)`` of every labelled document.

    Role ``fit`` (three quarters of the trusted ones: quality 1, not toxic)
    trains, ``good`` (the other trusted ones) and ``bad`` (quality 0)
    calibrate; ``toxic_fit`` and ``toxic`` do so for toxic documents that are
    not ``bad``.  The role depends on a hash of the id only.  Of several labels
    of one document the worst holds; null labels say nothing.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("quality").cast("int").alias("quality"),
                         F.col("toxic").cast("int").alias("toxic"))
           .where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic <> 0)")
           .groupBy("doc_id").agg(F.min("quality").alias("quality"),
                                  F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")))
    role = (F.when(F.col("quality") == 0, "bad")
            .when((F.col("toxic") != 0) & (F.pmod(h, F.lit(4)) > 0), "toxic_fit")
            .when(F.col("toxic") != 0, "toxic")
            .when(F.pmod(h, F.lit(4)) > 0, "fit")
            .otherwise("good"))
    return one.select("doc_id", role.alias("role"), h.alias("h")).where("role IS NOT NULL")


def sample(labels: DataFrame, most: int = MOST_LABELS, seed: int = 7, role: str = "fit") -> DataFrame:
    """``(doc_id, role)`` of at most ``most`` documents of a role that trains."""
    return (roles(labels, seed).where(F.col("role") == role)
            .orderBy("h", "doc_id").limit(most).select("doc_id", "role"))


def model(docs: DataFrame, labels: DataFrame, buckets: int = ngrams.BUCKETS,
          most: int = MOST_LABELS) -> tuple[np.ndarray, float]:
    """Log ratio per bucket and the cut on the mean log ratio of a document.

    The raw multinomial covers every n-gram of every document, the target
    multinomial those of the ``fit`` sample.  The cut is chosen on all held-out
    labelled documents.  Without labels all ratios are 0 and the cut is -inf.
    """
    docs = documents(docs)
    # at most ``most`` rows of two short columns: a proven broadcast bound
    fit = F.broadcast(sample(labels, most))
    marked = docs.join(fit, "doc_id", "left").select(
        "text", (F.col("role") == "fit").alias("trusted"))
    ratio = ngrams.log_ratio(ngrams.histogram(marked, buckets), buckets)
    return ratio, cut(docs, roles(labels).where("role IN ('good', 'bad')"),
                      lambda text: _mean(*ngrams.scores(text, ratio)))


def toxicity(docs: DataFrame, labels: DataFrame, buckets: int = TOXIC_BUCKETS,
             most: int = MOST_LABELS) -> tuple[np.ndarray, float]:
    """Evidence per cell, toxic over trusted, and the least ``mildness`` that is kept.

    A toxic document may be a few words in a long clean one, so a cell's
    evidence is the log ratio of the shares of documents that hold it, and a
    document is judged by its strongest cell.  Without toxic labels to train
    and to calibrate nothing is rejected.
    """
    docs = documents(docs)
    fit = sample(labels, most).unionByName(sample(labels, most, role="toxic_fit"))
    marked = docs.join(F.broadcast(fit), "doc_id").select("text", (F.col("role") == "fit").alias("trusted"))
    held, n_all, n_trusted = np.zeros((2, buckets)), 0, 0
    for r in ngrams.holders(marked, buckets).collect():
        if r["bucket"] < 0:
            n_all, n_trusted = r["raw"], r["target"]
        else:
            held[:, r["bucket"]] = r["raw"] - r["target"], r["target"]
    n_toxic = n_all - n_trusted
    if not n_toxic or not n_trusted:
        return np.zeros(buckets), -math.inf
    evidence = np.log((held[0] + 0.5) / (n_toxic + 1)) - np.log((held[1] + 0.5) / (n_trusted + 1))
    return evidence, cut(docs, roles(labels).where("role IN ('good', 'toxic')"), lambda text: mildness(text, evidence))


def mildness(column: pa.Array, evidence: np.ndarray) -> np.ndarray:
    """Minus the strongest toxic evidence in each row; NaN without n-grams."""
    return -ngrams.strongest(column, evidence)


def mild(column: pa.Array, toxic: tuple[np.ndarray, float]) -> np.ndarray:
    """Is a row kept by the cut of ``toxicity``?"""
    if not math.isfinite(toxic[1]):
        return np.ones(len(column), bool)
    return ~(mildness(column, toxic[0]) < toxic[1])


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def cut(docs: DataFrame, held_out: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> float:
    """The cut on ``score`` with the fewest weighted errors on ``held_out(doc_id, role)``.

    Of equally good cuts the middle of the widest interval is taken.  Documents
    are scored where they are and only ids and cells meet the labels; the driver
    gets a histogram with CELLS cells a unit, not the documents.  A document
    that scores NaN has no place in it.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = score(batch.column("text"))
            some = ~np.isnan(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(pa.array(some)),
                 pa.array(np.floor(value[some] * CELLS).astype(np.int64))], ["doc_id", "cell"])

    rows = (docs.where("doc_id IS NOT NULL").mapInArrow(cells, "doc_id long, cell long")
            .join(held_out.select("doc_id", (F.col("role") == "good").alias("good")), "doc_id")
            .groupBy("cell").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
            .orderBy("cell").collect())
    n_good, n_bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not n_good or not n_bad:
        return -math.inf
    best, widest, at, below, above = math.inf, 0.0, -math.inf, 0, n_bad
    for i, r in enumerate(rows):  # cut between the cells before and row i
        cost = GOOD_WEIGHT * below / n_good + above / n_bad
        width = r["cell"] - rows[i - 1]["cell"] if i else 1
        if cost < best or cost == best and width > widest:
            best, widest = cost, width
            at = (r["cell"] + rows[i - 1]["cell"] + 1) / 2 if i else r["cell"]
        below += r["good"]
        above -= r["bad"]
    return at / CELLS
