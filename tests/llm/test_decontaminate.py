"""Decontamination against plain Python."""

import hashlib
import random
import re

from razao.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, benchmark):
    items = [(i or "", words(t)) for i, t in benchmark]
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, ids = set(), set()
        for item_id, x in items:
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == x[a:a + n]:
                        hit.update(range(p, p + n))
                        ids.add(item_id)
        out.append((doc_id, len(w), len(hit), len(ids),
                    hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_decontaminate(spark, rows, docs, vocabulary):
    rng = random.Random(1)
    pick = lambda i, a, b: " ".join((rows[i][1] or "").split()[a:b])
    bench = [("10", pick(5, 3, 40).upper()), ("9", pick(44, 45, 70)), ("a", pick(6, 0, 9) + " unseen"), ("b", "one two"),
             ("c", ""), ("d", None), ("e", "loop " * 12), (None, pick(12, 20, 31)), ("9", pick(13, 1, 15)),
             ("f", " ".join(rng.choice(vocabulary) for _ in range(30))), ("g", pick(20, 0, 12).replace(" ", ", ")),
             ("10", pick(5, 3, 40).upper()), ("h", "an")]
    table = spark.createDataFrame([(*b, "clash") for b in bench], "item_id string, text string, hits string")
    got = sorted((tuple(r) for r in dec.digest(dec.decontaminate(docs, table)).collect()), key=key)
    assert got == sorted(brute([(r[0], r[1]) for r in rows], bench), key=key)
    kept = dec.clean_documents(docs, table)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[-1] for r in got)
    near = {(r["doc_id"], r["item_id"]) for r in dec.proximity_matches(docs, table).collect()}
    assert {(44, "9"), (20, "g")} <= near


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x y beta"), (2, "alpha beta"), (3, "alpha" + " z" * 9 + " beta"), (4, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([("i", "alpha beta")], "item_id string, text string")
    got = {r["doc_id"] for r in dec.proximity_matches(docs, bench, slop=2).collect()}
    assert got == {1, 2}


def test_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert dec.decontaminate(no_docs, none).count() == 0
    assert {r["contaminated"] for r in dec.digest(dec.decontaminate(docs, none)).collect()} == {False}
