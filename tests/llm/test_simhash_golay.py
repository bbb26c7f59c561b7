"""Golay keys against the code's definition, components against all pairs."""

import itertools
import random
import re

import numpy as np
import xxhash

from razao.llm import simhash_golay as sg

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = ["doc_id", "fingerprint", "component_id"]


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    runs = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """sorted (doc_id, fingerprint, component_id) from all pairs of fingerprints"""
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    nodes = sorted({f for _, f in fp})
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, f in fp:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in fp), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*FIELDS).collect()), key=str)


def test_golay_words_at_distance_two_share_an_index():
    golay, rng = sg.Golay(), random.Random(3)
    for _ in range(300):
        word = rng.getrandbits(23)
        bits = rng.sample(range(23), rng.choice([0, 1, 2]))
        row, index = golay.indices(np.array([word, word ^ sum(1 << b for b in bits)]))
        own = [set(index[row == r]) for r in (0, 1)]
        assert own[0] & own[1]
        assert len(own[0]) == (row == 0).sum()
    codewords = [(m << 11) | int(golay.upper[m]) for m in range(4096)]
    assert min((a ^ codewords[1]).bit_count() for a in codewords if a != codewords[1]) == 7
    word = rng.getrandbits(23)
    near = {c >> 11 for c in codewords if (c ^ word).bit_count() <= 4}
    assert set(golay.indices(np.array([word]))[1]) == near


def test_linked_fingerprints_share_a_key():
    golay, rng = sg.Golay(), random.Random(4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2])))
        row, key = sg.fuzzy_keys(np.array([x, y], np.uint64), golay)
        assert set(key[row == 0]) & set(key[row == 1])


def test_documents(spark, docs, rows):
    assert found(sg.near_duplicates(docs)) == brute([(r[0], r[1]) for r in rows])


def test_pieces_do_not_change_fingerprints(monkeypatch, rows):
    for size in (1, 7, 64):
        monkeypatch.setattr(sg, "PIECE", size)
        for r in rows[:52] + rows[53:]:
            assert sg.fingerprint(None if r[1] is None else r[1].encode()) == brute_fingerprint(r[1])


def test_links_of_close_fingerprints(spark):
    """Dense neighbourhoods, by pairs and by hubs, give the links' components."""
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1, 1 << 63}
    for c in centres:
        low = rng.sample(range(43, 64), 5)  # a third segment that differs, so keys are crowded
        for _ in range(60):
            fps.add(c ^ sum(1 << b for b in rng.sample(low + rng.sample(range(64), 3), rng.randint(0, 4))))
    nodes = sorted(fps)
    edges = {(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 2}

    def components(pairs):
        root = {f: f for f in nodes}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(f for f in nodes if find(f) == r) for r in {find(f) for f in nodes}}

    signed = [int(np.uint64(f).astype(np.int64)) for f in nodes]
    vertices = spark.createDataFrame([(f, f) for f in signed], "fp long, least long")
    for most in (1, 8, 1000):
        got = {(r.a % 2**64, r.b % 2**64) for r in sg.links(vertices, most).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in got)
        assert components(got) == components(edges)
        if most == 1000:
            assert {tuple(sorted(p)) for p in got} == edges


def test_null_ids_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (4, "A b  c\nd"), (5, "")], "doc_id long, text string")
    assert found(sg.near_duplicates(df)) == brute([(None, "a b c d"), (None, None), (4, "A b  c\nd"), (5, "")])
    assert found(sg.near_duplicates(no_docs)) == []
