"""Training-order shards: permutation, fixed stride, exact round trip."""

import glob
from collections import defaultdict

import numpy as np
import pytest

from razao.llm import token_output as to


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = to.Feistel(n, 99)
    slots = p.slot(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert list(p.index(slots)) == list(range(n))
    if n > 100:
        assert list(to.Feistel(n, 98).slot(np.arange(n))) != list(slots)
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.15


def texts_of(read):
    """(doc_id, text) for each run of sequences that starts at seq_no 0, in index order."""
    out = defaultdict(list)
    for r in read:
        out[r["doc_id"]].append((r["seq_no"], r["ids"]))
    return out


def round_trip(docs, rows, tmp_path, decode, **options):
    layout = to.materialise(docs, f"{tmp_path}/shards", **options)
    read = to.read_shards(docs.sparkSession, layout).collect()
    assert sorted(r["slot"] for r in read) == list(range(layout.n))
    by_slot = {r["slot"]: r for r in read}
    # the index order is document after document, sequence after sequence
    order = to.Feistel(layout.n, layout.key).slot(np.arange(layout.n))
    texts, current = [], None
    for slot in order:
        r = by_slot[slot]
        assert layout.place(slot) == (r["shard"], r["byte_offset"])
        assert r["n_tokens"] <= layout.length
        if r["seq_no"] == 0:
            current = [r["doc_id"], b""]
            texts.append(current)
        current[1] += r["ids"]
    assert sorted(((i, decode(b)) for i, b in texts), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    # any record can be read at its offset alone
    for slot in (0, layout.n // 2, layout.n - 1):
        shard, offset = layout.place(slot)
        (file,) = glob.glob(f"{layout.path}/shard={shard}/part-*")
        with open(file, "rb") as f:
            f.seek(offset)
            raw = f.read(layout.stride)
        assert raw[-1] == 0x0A and raw[to.HEADER.itemsize:].startswith(by_slot[slot]["ids"])
    return read


def byte_text(b):
    assert b[-1] == 0xFF
    return b[:-1].decode()


def test_round_trip(docs, rows, tmp_path):
    read = round_trip(docs, rows, tmp_path, byte_text, length=100, shard_bytes=5000)
    assert len({r["shard"] for r in read}) > 3
    again = to.read_shards(docs.sparkSession, to.materialise(docs, f"{tmp_path}/again", length=100, shard_bytes=5000))
    assert again.count() == len(read)


def test_round_trip_of_files(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    one = round_trip(d, rows, tmp_path, byte_text, length=256, shard_bytes=40000)
    digest = to.digest(to.training_order(d, length=256, shard_bytes=40000)).collect()
    assert {(r["slot"], r["doc_id"], r["seq_no"]) for r in digest} == {(r["slot"], r["doc_id"], r["seq_no"]) for r in one}


def test_bpe_round_trip(docs, rows, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    import base64
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb").read().splitlines() if x)}
    bpe = tiktoken.Encoding("t", pat_str=to.PIECES, mergeable_ranks=ranks, special_tokens={})
    end = max(ranks.values()) + 1

    def decode(b):
        ids = np.frombuffer(b, "<u2")
        assert ids[-1] == end
        return bpe.decode(ids[:-1].tolist())

    round_trip(docs, rows, tmp_path, decode, length=64, shard_bytes=5000, vocabulary=path)


def test_empty(no_docs):
    assert to.training_order(no_docs).count() == 0
