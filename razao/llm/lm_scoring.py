"""LM scoring with stupid backoff, computed relationally.

Counts: documents are read in blocks; a block's distinct 1-, 2- and 3-grams go
as sorted hashes with their local counts to hash buckets, which sum them over
the corpus.  That is the n-gram count table, partitioned by hash.  Scores: the
table is joined back to the exploded n-grams block by block, and the log scores
are summed per document.  Both ways an entry is a packed hash or count, not a
row.  Every document adds to the counts; nothing is sampled or capped.

With f the corpus counts, a word w after a, b scores

    f(a b w) / f(a b)            if f(a b w) >= min_count
    alpha * f(b w) / f(b)        else if f(b w) >= min_count
    alpha**2 * f(w) / N          else

and the first words of a document use the shorter contexts they have.  Words
are runs of bytes other than white space, ASCII letters in lower case.  N-grams
are known by 56 bits of hash.

Defined results: a text without words (null, empty) has log score 0 and no mean;
repeated rows count each time they occur and get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import groups, pack, unpack
from .scans import repeatable
from .tables import documents, stored
from .textbatch import LOWER, U64, PrefixHash, Texts, mix, slices

ALPHA = 0.4
MIN_COUNT = 2
ORDERS = 3
#: bytes of text in a block, and of the whole corpus behind one hash bucket
BLOCK_BYTES = 8 << 20
#: bytes hashed at a time
HASH_BYTES = 2 << 20
BUCKET_BYTES = 7 << 20

_BITS = U64((1 << 56) - 1)


def grams(texts: Texts) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Document of each word; per order the n-gram ending at each word that has
    one, and those words."""
    words, docs, row = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    while row < texts.n:  # a few documents at a time: prefix hashes take 24 bytes a byte
        upto = int(np.searchsorted(texts.offsets, texts.offsets[row] + HASH_BYTES, side="right")) - 1
        upto = min(max(upto, row + 1), texts.n)
        part = Texts(LOWER[texts.data[texts.offsets[row]: texts.offsets[upto]]],
                     texts.offsets[row: upto + 1] - texts.offsets[row], 0)
        start, end, doc = part.words()
        words.append(PrefixHash(part.data).of(start, end, 30))
        docs.append(doc + row)
        row = upto
    word, doc = np.concatenate(words), np.concatenate(docs)
    at = np.arange(len(word))
    first = np.searchsorted(doc, doc)  # the document's first word
    out, where, gram = [], [], word
    for order in range(ORDERS):
        if order:
            gram = mix(np.concatenate([[U64(0)], gram[:-1]]) * U64(3) + word, 30 + order)
        have = at - first >= order
        out.append(gram[have] & _BITS)
        where.append(at[have])
    return doc, out, where


def _distinct(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in order of (bucket, hash), their number, and the place
    of each occurrence among them."""
    values, place, n = np.unique(gram, return_inverse=True, return_counts=True)
    order = np.argsort(values % U64(buckets), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], n[order], rank[place]


def _steps(values: np.ndarray, buckets: int) -> np.ndarray:
    """The sorted hashes of one bucket as differences: the remainder is the
    bucket's, and small numbers pack well.  Their sums tell the hashes apart."""
    return np.diff(values // U64(buckets), prepend=U64(0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """``(block, ids, texts)``: runs of some BLOCK_BYTES in the order of the scan."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for run in slices(batch.column("text"), BLOCK_BYTES):
            yield (task << 32) + number, batch.column("doc_id").slice(run.first, run.n), run
            number += 1


def count_tables(docs: DataFrame, buckets: int) -> DataFrame:
    """``(block, bucket, cell)``: the corpus counts of the n-grams a block asked
    for, in the order it asked."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            _, by_order, _ = grams(texts)
            parts = []
            for gram in by_order:
                values, n, _ = _distinct(gram, buckets)
                parts.append((values, n.astype(np.uint32), np.searchsorted(values % U64(buckets), np.arange(buckets + 1))))
            cells = [pack(*[a for values, n, edge in parts
                            for a in (_steps(values[edge[b]:edge[b + 1]], buckets), n[edge[b]:edge[b + 1]])])
                     for b in range(buckets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(buckets, block)), pa.array(np.arange(buckets)), pa.array(cells, pa.binary())],
                ["block", "bucket", "cell"])

    def answer(bucket: pa.Table) -> pa.Table:
        asked = [unpack(c, *["u8", "u4"] * ORDERS) for c in bucket.column("cell").to_pylist()]
        totals = []
        for order in range(ORDERS):
            gram = np.concatenate([np.cumsum(a[2 * order], dtype=U64) for a in asked])
            n = np.concatenate([a[2 * order + 1] for a in asked]).astype(np.uint64)
            by = np.argsort(gram, kind="stable")
            starts, bounds = groups(gram[by])
            total = np.empty(len(gram), np.uint64)
            if len(gram):
                total[by] = np.repeat(np.add.reduceat(n[by], starts), np.diff(bounds))
            totals.append(np.split(total, np.cumsum([len(a[2 * order]) for a in asked])[:-1]))
        cells = [pack(*[t[i] for t in totals]) for i in range(len(asked))]
        return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"),
                         "cell": pa.array(cells, pa.binary())})

    schema = "block long, bucket long, cell binary"
    return docs.select("doc_id", "text").mapInArrow(ask, schema).groupBy("bucket").applyInArrow(answer, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """``(block, cell)``: the texts of a block, compressed, with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            cell = pack(texts.data, texts.offsets.astype(np.int64),
                        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                        np.asarray(ids.is_valid()).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([cell], pa.binary())], ["block", "cell"])

    return docs.select("doc_id", "text").mapInArrow(run, "block long, cell binary")


def lm_scores(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """``(doc_id, n_words, n_backoff, log_score, mean_log_score)`` of every document.

    ``n_backoff`` is the number of words scored by a single-word count.
    """
    docs = documents(repeatable(docs))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = int(total // BUCKET_BYTES) + 1

    def score(_key, block: pa.Table, counts: pa.Table) -> pa.Table:
        data, offsets, ids, known = unpack(block.column("cell")[0].as_py(), "u1", "i8", "i8", "u1")
        texts = Texts(data, offsets, 0)
        doc, by_order, where = grams(texts)
        order = np.argsort(counts.column("bucket").to_numpy())
        answers = [unpack(counts.column("cell")[int(i)].as_py(), *["u8"] * ORDERS) for i in order]
        f = []  # per order: the count of the n-gram that ends at each word, 0 where there is none
        for k in range(ORDERS):
            values, _, place = _distinct(by_order[k], buckets)
            have = np.concatenate([a[k] for a in answers]).astype(np.float64)
            if len(have) != len(values):
                raise RuntimeError("a scan dealt other rows than the scan before it")
            one = np.zeros(len(doc))
            one[where[k]] = have[place]
            f.append(one)
        before = [np.concatenate([[0.0], x[:-1]]) for x in f]  # the same ending one word earlier
        depth = np.zeros(len(doc), np.int64)
        for k in range(1, ORDERS):
            depth[where[k]] = k
        # f(w), without 1 / N; then the longer n-grams that occur often enough
        value = np.log(np.maximum(f[0], 1))
        used = np.zeros(len(doc), np.int64)
        for k in range(1, ORDERS):
            enough = (depth >= k) & (f[k] >= min_count)
            value[enough] = np.log(f[k][enough]) - np.log(before[k - 1][enough])
            used[enough] = k
        value += np.log(alpha) * (depth - used)
        n = np.bincount(doc, minlength=texts.n)
        return pa.table({
            "doc_id": pa.array(ids, mask=known == 0), "n_words": pa.array(n),
            "n_backoff": pa.array(np.bincount(doc[used == 0], minlength=texts.n)),
            "part": pa.array(np.bincount(doc, value, texts.n))})

    counts = count_tables(docs, buckets)
    parts = stored(_packed(docs).groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, n_backoff long, part double"), "lm-parts")
    # every word scored by its own count lacks the factor 1 / N
    n = float(max(parts.agg(F.sum("n_words")).first()[0] or 0, 1))
    log_score = F.col("part") - F.col("n_backoff") * F.log(F.lit(n))
    return parts.select("doc_id", "n_words", "n_backoff", log_score.alias("log_score"),
                        F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"))
