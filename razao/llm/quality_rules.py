"""Quality rules by a hashed n-gram log-likelihood ratio.

Every document gets the length-normalised log-likelihood ratio between a
trusted-target multinomial and the raw-corpus multinomial over hashed
unigrams and bigrams, and one threshold decides; a document with a cell that
tells toxic labels from trusted ones (``labelled.toxicity``) is not kept.  The raw counts cover the
whole corpus, the threshold comes from all held-out labelled documents; only
the target counts come from a bounded sample (``labelled.MOST_LABELS``).

Two passes over the corpus, no shuffle of texts: the first sums one vector of
``ngrams.BUCKETS`` cells, the second scores each document in its own row.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows are judged alike, each on its own; without labels every document
that passes the base rules is kept; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled, ngrams
from .tables import documents
from .textbatch import U64, PrefixHash, Texts, mix, per_doc, repeated, runs, slices

# fixed values of the base rules
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, llr double")


def text_counts(texts: Texts) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by document."""
    n, data = texts.n, texts.data
    start, end, doc = texts.words()
    hashes = PrefixHash(data)
    # code points: every byte but UTF-8 continuation bytes, inside words
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = per_doc((heads[end] - heads[start]).astype(float), doc, n).astype(np.int64)
    n_symbols = per_doc(None, texts.doc_of(np.flatnonzero(_SYMBOL[data])), n)

    line_start, line_end = runs(data != 0x0A, texts.offsets)
    first_word = np.searchsorted(start, line_start)
    with_word = (first_word < len(start)) & (np.append(start, 1 << 62)[first_word] < line_end)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_doc = texts.doc_of(line_start)
    _, later = repeated(line_doc, hashes.of(line_start, line_end))
    n_dup_lines = per_doc(None, line_doc[later], n)

    word = hashes.of(start, end)
    hit = np.zeros(len(start), dtype=bool)
    if len(start) >= 3:
        inside = doc[2:] == doc[:-2]
        three = mix(mix(word[:-2] + U64(1)) * U64(3) + mix(word[1:-1], 1) * U64(5) + word[2:], 2)
        at = np.flatnonzero(inside)
        again, _ = repeated(doc[at], three[at])
        for step in range(3):
            hit[at[again] + step] = True
    return (per_doc(None, doc, n), word_chars, n_symbols, n_dup_lines, per_doc(None, doc[hit], n))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = ngrams.BUCKETS,
                  most_labels: int = labelled.MOST_LABELS) -> DataFrame:
    """Base counts, log-likelihood ratio and verdict of every document."""
    ratio, threshold = labelled.model(docs, labels, buckets, most_labels)
    toxic = labelled.toxicity(docs, labels, most=most_labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            total, n = ngrams.scores(text, ratio)
            parts = [text_counts(texts) for texts in slices(text)]
            counts = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5)]
            n_words, repeat = counts[0], counts[4]
            llr = total / np.maximum(n, 1)
            failed = (n_words < LEAST_WORDS) | (100 * repeat > MOST_REPEATED_PERCENT * n_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(failed),
                 pa.array(~failed & (llr >= threshold) & labelled.mild(text, toxic)), pa.array(llr)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept", "llr"])

    return documents(docs).mapInArrow(judge, SCHEMA)
