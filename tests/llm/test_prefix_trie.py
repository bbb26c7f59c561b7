"""Trie nodes against a plain dictionary of prefixes, and against DuckDB."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from razao.llm import prefix_trie as pt
from razao.llm.queries import op13_prefix_trie
from razao.llm.sql import PREFIX_TRIE

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), role, name, text))
    turns = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    return out


def brute(rows):
    seqs = rebuilt(rows)
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in children[p])
    return sorted(((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p],
                    saved[p], hashlib.sha256(",".join(str(c) for c in members[p] if len(seqs[c]) == len(p)).encode()).hexdigest())
                   for p in members), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)


def query(spark, rows, block=pt.BLOCK):
    return found(pt.trie(pt.branched(pt.conversations(frame(spark, rows))), block))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in range(160):
        start = rng.choice([["hi"], ["hi", "there"], ["hi", "there", "ü"], []])
        for t, text in enumerate(start + [rng.choice(["a", "bb", "", None]) for _ in range(rng.randint(0, 12))]):
            out.append((c, t, rng.choice(["user", "user", None]), text))
    for c in range(200, 260):  # copies
        out += [(c, t, "user", f"copy {t}") for t in range(11)]
    out += [(300, None, "user", "first"), (300, None, None, "before"), (300, 0, "user", "x" * 5000), (300, 0, "user", "x" * 5000)]
    out += [(305 + i % 2, i, "user", "long") for i in range(600)]
    out += [(-7, 0, "user", "minus"), (None, 0, "user", "nobody"), (None, None, None, None), (402, 0, "user", "no base")]
    return out


def test_against_a_dictionary_of_prefixes(spark, rows):
    assert query(spark, rows) == brute(rows)


def test_prefixes_open_over_many_blocks(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert query(spark, rows, 8) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_small_tables(spark):
    assert query(spark, []) == []
    assert query(spark, [(None, 0, "user", "nobody")]) == []
    turnless = [(1, 0, "user", "a")]  # no base, and its own first turn is left out
    assert zlib.crc32(b"1") % 9 >= 1
    assert query(spark, turnless) == brute(turnless) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    one = [(5, t, "user", "a") for t in range(3)]
    assert query(spark, one) == brute(one)


def test_extents_by_binary_steps():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 33):
        lcp = np.append([-1], rng.integers(0, 5, n - 1))
        table = pt.RangeMinimum(lcp)
        for i in range(n):
            for d in range(6):
                left = right = i
                while lcp[left] >= d:
                    left -= 1
                while right + 1 < n and lcp[right + 1] >= d:
                    right += 1
                at, least = np.array([i]), np.array([d])
                assert (table.leftmost(at, least)[0], table.rightmost(at, least)[0]) == (left, right)
                assert table.of(np.array([left]), np.array([right]))[0] == lcp[left:right + 1].min()


def test_against_duckdb(spark):
    db = duckdb.connect()
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        db.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        want = sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({PREFIX_TRIE})").fetchall(), key=str)
        assert found(op13_prefix_trie(spark, sf)) == want
