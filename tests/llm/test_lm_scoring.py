"""Stupid backoff against counts of word tuples in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from razao.llm import lm_scoring as lm
from razao.llm.blobs import pack


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows, alpha=0.4, k=2):
    docs = [(i, words(t)) for i, t in rows]
    f = Counter()
    for _, w in docs:
        for n in (1, 2, 3):
            f.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in docs)
    out = []
    for doc_id, w in docs:
        score, single = 0.0, 0
        for i in range(len(w)):
            for n in range(min(i, 2), -1, -1):
                gram = tuple(w[i - n:i + 1])
                if n == 0:
                    s, single = f[gram] / total, single + 1
                elif f[gram] >= k:
                    s = f[gram] / f[gram[:-1]]
                else:
                    continue
                score += math.log(s) + (min(i, 2) - n) * math.log(alpha)
                break
        out.append((doc_id, len(w), single, score))
    return out


def key(r):
    return tuple((x is None, x) for x in r[:3])


@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_scores(docs, rows, block, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 5000)
    got = sorted((tuple(r)[:4] for r in lm.lm_scores(docs).collect()), key=key)
    want = sorted(brute([(r[0], r[1]) for r in rows]), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_given_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in lm.lm_scores(d).collect()}
    for i, n, single, score in brute([(r["doc_id"], r["text"]) for r in d.collect()]):
        assert (got[i]["n_words"], got[i]["n_backoff"]) == (n, single)
        assert got[i]["log_score"] == pytest.approx(score)
        assert got[i]["mean_log_score"] == pytest.approx(score / n) if n else got[i]["mean_log_score"] is None


def test_empty(no_docs):
    assert lm.lm_scores(no_docs).count() == 0


@pytest.mark.parametrize("buckets", [1, 73, 4286])
def test_asked_hashes_are_packed_small(buckets):
    # hashes of one bucket, as many as a block of 8 MB asks of it
    q = np.unique(np.random.default_rng(5).integers(0, (1 << 56) // buckets, 1_000_000 // buckets, dtype=np.uint64))
    values = q * np.uint64(buckets) + np.uint64(buckets - 1)
    steps = lm._steps(values, buckets)
    assert (np.cumsum(steps, dtype=np.uint64) == q).all()
    assert len(pack(steps)) < 5.5 * len(values) + 100
    assert len(lm._steps(values[:0], buckets)) == 0
