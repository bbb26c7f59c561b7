"""Near-duplicate classes against all pairs in plain Python."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from razao.llm import near_dedup as nd
from razao.llm.components import connected_components
from razao.llm.textbatch import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weighted(text):
    w = WORD.findall(text or "")
    if not w:
        return {}
    n = min(5, len(w))
    return {s: 1 + math.log(c) for s, c in Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)).items()}


def probability_jaccard(a, b):
    total = 0.0
    for x in a.keys() & b.keys():
        total += 1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys())
    return total


def similar(a, b):
    return max(probability_jaccard(a, b), len(a.keys() & b.keys()) / len(a.keys() | b.keys())) >= 0.8


def brute_classes(rows):
    """class id by row, from all pairs of distinct texts that share a shingle"""
    sets = {t: weighted(t) for _, t in rows if weighted(t)}
    parent = {t: t for t in sets}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    by = defaultdict(list)
    for t, s in sets.items():
        for x in s:
            by[x].append(t)
    for a, b in {tuple(sorted(p)) for ts in by.values() for p in itertools.combinations(ts, 2)}:
        if find(a) != find(b) and similar(sets[a], sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if t in sets and i is not None:
            least[find(t)] = min(least.get(find(t), i), i)
    return [(i, least.get(find(t)) if t in sets else i) for i, t in rows]


def key(r):
    return tuple((x is None, x) for x in r)


def test_near_duplicates(docs, rows):
    got = sorted(map(tuple, nd.near_duplicates(docs).collect()), key=key)
    assert got == sorted(brute_classes([(r[0], r[1]) for r in rows]), key=key)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    full = [t for t in texts if WORD.search(t or "")]
    n_classes = len({c for (i, c), r in zip(brute_classes([(r[0], r[1]) for r in rows]), rows) if WORD.search(r[1] or "")})
    # ids 7 and 8 name two texts each in places, so classes may share a number
    assert len(full) == len(set(full)) and n_classes <= len(full) <= n_classes + 1
    assert len(texts) - len(full) == 3


def test_group_of_edited_copies(spark, vocabulary):
    """Copies of one text with edits, whose original is not the smallest id."""
    rng = random.Random(2)
    base = [rng.choice(vocabulary) + str(i) for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    for i in range(60):  # a family around 0.6 to 0.8 of each other
        w = list(base[:120]) + [f"tail{i}_{k}" for k in range(rng.randint(10, 30))]
        rows.append((1000 + i, " ".join(w)))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(rows))


def test_given_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert sorted(map(tuple, nd.near_duplicates(d).collect()), key=key) == sorted(brute_classes(rows), key=key)


def test_registers_estimate_probability_jaccard():
    rng = random.Random(3)
    a = [rng.choice("abcdefghij") for _ in range(300)]
    b = a[:240] + [rng.choice("klmnopq") for _ in range(90)]
    texts = next(slices(pa.array([" ".join(a), " ".join(b)])))
    doc, gram, weight = nd.shingles(texts)
    win = nd.registers(doc, gram, weight, 2, 4000)
    want = probability_jaccard(weighted(" ".join(a)), weighted(" ".join(b)))
    exact, plain = nd.similarities(*(next(slices(pa.array([" ".join(t)]))) for t in (a, b)))
    assert abs(exact - want) < 1e-9
    assert abs((win[0] == win[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4000)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(f"n{a:04d}", f"n{b:04d}") for a, b in rng.integers(0, 900, (500, 2))]
    edges += [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_empty(no_docs):
    assert nd.near_duplicates(no_docs).count() == 0
    assert nd.keep_one(no_docs).count() == 0


def test_texts_that_differ_in_white_space_only(spark):
    """Candidates without a shingle of their own."""
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one two  three four five six"), (3, "quite other words than these")],
                               "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(df).select("doc_id", "class_id").collect())) == [(1, 1), (2, 1), (3, 3)]


def test_pairs_in_a_group_grow_with_its_size(spark, vocabulary, monkeypatch):
    """Copies with the same few edits share shingles that are not the original's; few of their pairs are made."""
    made = []
    keep = nd.stored

    def stored(df, name):
        out = keep(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(nd, "stored", stored)
    rng = random.Random(4)
    base = [rng.choice(vocabulary) + str(i) for i in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(100):
        w = list(base)
        for at in rng.sample(range(5, 145, 6), 4):
            w[at] = f"edit{at}"
        rows.append((i, " ".join(w)))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    # no shingle occurs twice in a text, so both similarities are the plain Jaccard
    sets = {i: frozenset(weighted(t)) for i, t in rows}
    of = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if of[a] != of[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((of[a], of[b]))
            of = {i: x if c == y else c for i, c in of.items()}
    assert dict(map(tuple, got)) == of
    assert sum(made) < 0.6 * len(rows) * (len(rows) - 1) / 2, made
