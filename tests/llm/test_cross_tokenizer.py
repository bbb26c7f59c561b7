"""Alignments against whole texts encoded by the libraries and aligned token by token."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from razao.llm import cross_tokenizer as ct

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a", " a", "  two  spaces ", "tab\tand\n new \n\n lines ", "x y  z", "▁ mark", "mid▁mark", "nul \x00 byte",
       "<|endoftext|> and <s> <unk> <0x41>", "日本語のテキスト と 漢字", "🙂🙃 emoji🙂 é", "don't 're 'll 12345 67 8", "\x1c sep \x1f",
       " ", "\n", "a" * 3000, "ab cd " * 4000, "ﬁn é é Ⅷ", "trailing ", "... --- !!! ???", "ñandú größe"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(f"{ct.TOKENIZERS}/{ct.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{ct.TOKENIZERS}/{ct.PIECE_BPE}")
    back = {c: x for c, x in ct.byte_alphabet().items()}
    bytes_a = {i: bytes(back[c] for c in p) for p, i in a.get_vocab(with_added_tokens=False).items()}
    return a, b, bytes_a


def groups_of(text, libraries):
    """[(A ids, B ids)] of a text, [] without tokens"""
    a, b, bytes_a = libraries
    if not text:
        return []
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    end_a, end_b, at = {}, {}, b""
    for k, i in enumerate(x):
        at += bytes_a[i]
        end_a[len(at)] = k + 1
    joined = b""
    for k, i in enumerate(y):
        joined += bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        end_b[len(joined)] = k + 1
    if not at == joined == (" " + text).encode():
        return []
    out, i, j = [], 0, 0
    for e in sorted(end_a.keys() & end_b.keys()):
        out.append((x[i:end_a[e]], y[j:end_b[e]]))
        i, j = end_a[e], end_b[e]
    return out


def brute(rows, libraries):
    links, count, best = [], Counter(), defaultdict(int)
    for _, text in rows:
        own = Counter()
        for x, y in groups_of(text, libraries):
            own.update((p, q) for p in x for q in y)
        links.append(own)
        count.update(own.keys())
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for (doc_id, text), own in zip(rows, links, strict=True):
        g = groups_of(text, libraries)
        digest = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        out.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(digest.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_documents(spark, docs, rows, libraries):
    assert found(ct.digest(docs)) == brute([(r[0], r[1]) for r in rows], libraries)


def odd_frame(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, ""), (None, "a b"), (3, "a b")]
    return rows, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pair string, block long")


def test_odd_texts(spark, libraries):
    rows, df = odd_frame(spark)
    assert groups_of(ODD[5], libraries) == groups_of(ODD[6], libraries) == []
    assert found(ct.digest(df)) == brute(rows, libraries)


def test_real_outputs(spark, libraries):
    rows, df = odd_frame(spark)
    want = sorted(((i, [t for x, _ in g for t in x], [t for _, y in g for t in y], [len(x) for x, _ in g], [len(y) for _, y in g])
                   for i, t in rows for g in [groups_of(t, libraries)]), key=str)
    assert sorted((tuple(r) for r in ct.align(df).collect()), key=str) == want


@pytest.fixture(scope="module")
def specs():
    with open(f"{ct.TOKENIZERS}/{ct.BYTE_BPE}", encoding="utf-8") as a, open(f"{ct.TOKENIZERS}/{ct.PIECE_BPE}", "rb") as b:
        return a.read(), b.read()


def texts_of(aligner, texts):
    return [None if x is None else ";".join(aligner.windows.text[w] for w in x.windows) for x in ct.aligned_run(aligner, texts)]


def test_pieces_slices_and_memos_change_nothing(specs, rows, monkeypatch):
    texts = [r[1] for r in rows] + ODD
    want = texts_of(ct.Aligner(*specs), texts)
    monkeypatch.setattr(ct, "PIECE", 20)
    monkeypatch.setattr(ct, "SLICE", 7)
    aligner = ct.Aligner(*specs)
    assert texts_of(aligner, texts) == want
    for most, size in ((5, None), (None, 100), (10**6, 10**9)):
        aligner.trim(most, size)
        assert most is None or len(aligner.words) <= most
        assert texts_of(aligner, texts) == want


def test_large_groups_by_distinct_ids(specs):
    import numpy as np

    aligner = ct.Aligner(*specs)
    a, b = np.array([5, 6, 5] * 40), np.array([7] * 50)
    shared_a, shared_b = np.zeros(120, bool), np.zeros(50, bool)
    shared_a[-1] = shared_b[-1] = True
    one = np.array([0])
    aligner._align(a, b, shared_a, shared_b, one, one + 120, one, one + 50)
    assert aligner.windows.pairs.data[:2].tolist() == [5 * ct.PAIR + 7, 6 * ct.PAIR + 7]
    assert aligner.windows.times.data[:2].tolist() == [4000, 2000]
    assert aligner.windows.groups.data[:2].tolist() == [1, 6000]


def test_table_of_the_smallest_size(spark, no_docs, libraries):
    assert found(ct.digest(no_docs)) == []
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert found(ct.digest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))) == brute(rows, libraries)
