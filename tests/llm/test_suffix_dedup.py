"""Passage removal against plain Python, and the suffix sort by itself."""

import hashlib
import random
import time

import numpy as np
import pytest

from razao.llm import suffix_dedup as sd
from razao.llm import tables

W = sd.WINDOW


def brute(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: sd.LAST if i is None else i
    for i, b in data:
        for p in range(len(b) - W + 1):
            s = b[p:p + W]
            first[s] = min(first.get(s, sd.LAST), order(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - W + 1):
            if first[b[p:p + W]] < order(i):
                gone[p:p + W] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_remove_repeats(docs, rows):
    got = sd.digest(sd.remove_repeats(docs)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute([(r[0], r[1]) for r in rows]), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_overlaps(spark, seed, monkeypatch):
    """Passages cut at odd places, repeats inside documents, tiny alphabets."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(40, 130))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 30):] + rng.choice(["", "x", "yz" * 20]) for _ in range(rng.randint(0, 5))))
            for i in range(120)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(sd, "FLUSH_BYTES", 3000)
    got = sd.digest(sd.remove_repeats(df)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, text), (2, text[700:2300] + "-" + text[100:160]), (0, text[995:1060])]
    monkeypatch.setattr(sd, "PIECE", 1000)
    got = sd.digest(sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_suffix_sort():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[1000:1200] = data[200:400]
    start = rng.permutation(2900)
    group = np.sort(rng.integers(0, 40, len(start)))
    sorter = sd.SuffixSort(data, 50)
    order = sorter.sort(start, group)
    have = [(g, data[s:s + 50].tobytes()) for g, s in zip(group, start[order])]
    assert have == sorted((g, data[s:s + 50].tobytes()) for g, s in zip(group, start))
    a, b = rng.integers(0, 2900, 500), rng.integers(0, 2900, 500)
    want = [next((k for k in range(50) if data[x + k] != data[y + k]), 50) for x, y in zip(a, b)]
    assert list(sorter.common(a, b)) == want


def test_hot_anchors(spark, monkeypatch):
    """A line held by all with other contexts: dealt by whole windows, same result."""
    rng = random.Random(5)
    line = "the quick brown fox jumps over the lazy dog and then some more of it"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 12))) + line[rng.randint(0, 9):] + word() * rng.randint(0, 9) + line)
            for i in range(150)]
    rng.shuffle(rows)
    rows += [(None, rows[3][1]), (rows[5][0], rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(sd, "SAMPLE", 1)
    monkeypatch.setattr(sd, "HOT_CONTEXTS", 3)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(sd, "FLUSH_BYTES", 3000)
    monkeypatch.setattr(sd, "SORT_BYTES", 2000)
    assert len(sd._hot(sd.keyed(df)))
    got = sd.digest(sd.remove_repeats(df)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_repeats_stay_out_of_buckets(spark, monkeypatch):
    """Copies in one task send the first holder's segments only, over several flushes."""
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(sd, "FLUSH_BYTES", 20_000)
    assert sorted(map(tuple, sd.digest(sd.remove_repeats(df)).collect())) == sorted(brute([(i, text) for i in range(300)]))
    cells = sd._anchored(sd.keyed(df), 1, np.zeros(0, sd.U64)).where("bucket >= 0").collect()
    monkeypatch.setattr("razao.llm.blobs._codec", {})  # a codec used here can't travel to the tasks of later tests
    entries = sum(len(sd.unpack(bytes(r["cell"]), *sd._ENTRY)[0]) for r in cells)
    assert entries == len(sd.segments(next(sd.slices(sd.pa.array([text]))))[0])


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Both joins read one exchange of the texts, which no table holds a copy of; verdicts go in packed rows."""
    rng, made = random.Random(1), {}
    pool = ["".join(rng.choice("abcdef ") for _ in range(120)) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool)[rng.randint(0, 30):] for _ in range(4))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def stored(df, name, **how):
        made[name] = tables_stored(df, name, **how)
        return made[name]

    tables_stored = sd.stored
    monkeypatch.setattr(sd, "stored", stored)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 20_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lost = sd.repeated_passages(docs)
        assert lost.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = lost._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("- Exchange hashpartitioning(ord") == 1 and "ReusedExchange" in final
    assert all("text" not in df.columns for df in made.values())
    assert made["verdicts"].count() < len(rows) / 2


def test_shuffle_files_of_a_stored_table_are_freed(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {files.apply(i).getName() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_")}

    before, value = shuffled(), spark.conf.get(tables._FREE, None)
    df = tables.stored(spark.range(1000).repartition(3, "id"), "freed", free=True)
    end = time.time() + 20
    while {f for f in shuffled() - before if f.endswith(".data")} and time.time() < end:
        time.sleep(0.2)
    assert not {f for f in shuffled() - before if f.endswith(".data")} and spark.conf.get(tables._FREE, None) == value
    assert df.count() == 1000


def test_runs_are_maximal(monkeypatch):
    """Spans of several cells, touching and nested ones, of documents that share an id or a key."""
    monkeypatch.setattr("razao.llm.blobs._codec", {})  # as above
    rng = np.random.default_rng(3)
    ord_, key = rng.integers(-2, 2, 300), rng.integers(-2, 2, 300).astype(np.int32)
    lo, cnt = rng.integers(0, 3000, 300).astype(np.int32), rng.integers(1, 36, 300)
    cells = [sd._to_docs(*(x[half] for x in (ord_, key, lo, cnt)), 1) for half in (slice(0, 100), slice(100, 300))]
    got = sd._runs_by_doc(sd.pa.concat_tables(cells)).to_pylist()
    for r in got:
        gone = np.zeros(4000, bool)
        for a, n in zip(lo[(ord_ == r["o"]) & (key == r["k"])], cnt[(ord_ == r["o"]) & (key == r["k"])]):
            gone[a:a + n + W - 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        assert list(zip(r["begin"], r["end"])) == [tuple(e) for e in edges.reshape(-1, 2).tolist()]
    assert len(got) == len({*zip(ord_.tolist(), key.tolist())})


def test_empty(no_docs):
    assert sd.digest(sd.remove_repeats(no_docs)).count() == 0
