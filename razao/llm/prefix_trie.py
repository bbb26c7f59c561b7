"""Trie of conversation prefixes from sorted sequences and range minima.

Conversations are sequences of turns (role, text).  Equal sequences are one row
with a count, so copies of any number weigh one row.  The rows are sorted by
their turns' hashes and dealt in ranges to blocks.  A prefix's members stand
side by side; a row begins the prefixes longer than what it shares with the row
before it.  In a block, a sparse table over those shared lengths (LCPs) gives
any range minimum in two look-ups, and every candidate prefix finds its leftmost
and rightmost member on its own, by binary steps over the table; a second table
gives the smallest id between them.  Sums over a subtree are differences of
running sums, as every distinct prefix is begun by one row.

Prefixes open at a block's border (the LCP across it is as long) come out of
several blocks with their part of each sum; those parts are added up by the
prefix's SHA-256.  A border opens as many prefixes as its LCP, so few rows meet
there, whatever the number of members.  Counts of children and distinct texts
are added once, by the row that begins them.

Turns are known by 128 bits of their SHA-256; texts are hashed where they are
read and not shuffled.  A conversation is one row of 24 bytes a turn.

Defined results: turns are ordered by ``turn`` (null first), ties by role, then
by the turn's hash; null role or text is empty; rows without conv_id are in no
conversation; repeated rows are repeated turns; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: bytes of a turn's name
NAME = 16
#: a conversation whose id is a multiple of this lends its first turns
FAMILY, LENT = 5, 9
#: turns of a block
BLOCK = 1 << 19

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends string, node binary, parent binary")


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: ``(name, bytes)`` of each turn in order."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    name = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.left(name, F.lit(2 * NAME)).alias("name"), F.octet_length(text).cast("long").alias("bytes"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "name", "bytes")))
    return rows.groupBy("conv_id").agg(ordered.alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["name"].alias("name"), x["bytes"].alias("bytes"))).alias("turns"))


def branched(own: DataFrame, family: int = FAMILY, lent: int = LENT) -> DataFrame:
    """Conversations rebuilt on the first turns of their family's eldest.

    The first h turns of conversation ``c - c % family`` (all if fewer), then c's
    own after its first h; h is crc32 of c's decimals modulo ``lent``.
    """
    own = stored(own, "own-turns")
    head = own.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, lent - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % lent).cast("int")
    rows = own.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % family})
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.join(head, F.col("of") == F.col("base"), "left").select("conv_id", F.concat(taken, rest).alias("turns"))


def sequences(rebuilt: DataFrame) -> DataFrame:
    """``(key, sizes, n, least, ends)`` of each distinct sequence, stored.

    ``ends`` is the SHA-256 of the ids that have it, in order, joined by commas;
    it takes them one at a time, so a group of any size needs no memory.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["name"]), ""))
    rows = rebuilt.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["bytes"]).alias("sizes"))
    rows = stored(rows.withColumn("digest", F.unhex(F.sha2("key", 256))), "members")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if digest != last:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = digest, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([e for _, e in done])],
                                                 ["of", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["of", "ends"])

    ends = (rows.select("digest", "conv_id").repartition("digest").sortWithinPartitions("digest", "conv_id")
            .mapInArrow(joined, "of binary, ends string"))
    distinct = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
                                          F.first("key").alias("key"), F.first("sizes").alias("sizes"))
    return stored(distinct.join(ends, F.col("digest") == F.col("of")).select("key", "sizes", "n", "least", "ends"),
                  "sequences")


def shared_length(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys begin with in common; -1 if there is no such key."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // NAME
    x, y = (np.frombuffer(k, np.uint64, 2 * n).reshape(n, 2) for k in (a, b))
    return int(np.logical_and.accumulate((x == y).all(axis=1)).sum())


def blocks(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sequences in sorted ranges: ``block``, and the LCP across both its borders, stored."""
    spark = distinct.sparkSession
    turns = distinct.agg(F.sum(F.size("sizes") + F.lit(1).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // block + 1)
    dealt = stored(distinct.repartitionByRange(parts, "key").withColumn("block", F.spark_partition_id()), "sorted")
    # a row a block: bounded by the number of partitions
    edges = dealt.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    in_order = Window.orderBy("block")
    edges = edges.select("block", "first", "last", F.lag("last").over(in_order).alias("before"),
                         F.lead("first").over(in_order).alias("after"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, before, after = (batch.column(c).to_pylist() for c in ("first", "last", "before", "after"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), pa.array(map(shared_length, before, first), pa.int64()),
                 pa.array(map(shared_length, last, after), pa.int64())], ["of", "lcp_left", "lcp_right"])

    borders = stored(edges.mapInArrow(shared, "of int, lcp_left long, lcp_right long"), "borders")
    return dealt.join(borders, F.col("block") == F.col("of")).drop("of")


class RangeMinimum:
    """Sparse table: the minimum of each run of 2**k values from each place."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minima of values[left..right], both ends included."""
        k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for level in np.unique(k):
            i = k == level
            row = self.levels[level]
            out[i] = np.minimum(row[left[i]], row[right[i] + 1 - (1 << level)])
        return out

    def rightmost(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place that values of ``least`` or more lead to, from after ``at`` on."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            row = self.levels[k]
            fits = at + 1 < len(row)
            step = np.zeros(len(at), bool)
            step[fits] = row[at[fits] + 1] >= least[fits]
            at[step] += 1 << k
        return at

    def leftmost(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which values of ``least`` or more lead up to ``at``, its own left out."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            row = self.levels[k]
            fits = at - (1 << k) >= 0
            step = np.zeros(len(at), bool)
            step[fits] = row[at[fits] - (1 << k) + 1] >= least[fits]
            at[step] -= 1 << k
        return at


def _shared_with_previous(names: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LCP of each row with the row before; -1 for the first row."""
    out = np.full(len(length), -1, np.int64)
    n = np.minimum(length[1:], length[:-1])
    start = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(start, n)
    same = (names[np.repeat(first[1:], n) + place] == names[np.repeat(first[:-1], n) + place]).all(axis=1)
    stop = np.where(same, np.repeat(n, n), place)
    out[1:] = 0
    some = np.flatnonzero(n)
    if len(some):
        out[1:][some] = np.minimum.reduceat(stop, start[some])
    return out


def _prefix_digests(key: bytes, upto: int) -> list[bytes]:
    """SHA-256 of the first 0 .. ``upto`` turns of a key."""
    state = hashlib.sha256()
    out = [state.digest()]
    for d in range(upto):
        state.update(key[NAME * d: NAME * (d + 1)])
        out.append(state.digest())
    return out


def block_nodes(table: pa.Table) -> pa.Table:
    """All nodes that a block's rows begin or lie in (columns of ``NODE``).

    ``node`` is set for prefixes open at a border: their other parts are in other
    blocks.  ``parent`` is set instead of ``parent_conv_id`` if the parent is open.
    """
    table = table.sort_by("key").combine_chunks()
    keys = table.column("key").to_pylist()
    left, right = (table.column(c)[0].as_py() for c in ("lcp_left", "lcp_right"))
    n, least = (table.column(c).to_numpy() for c in ("n", "least"))
    ends = table.column("ends").to_numpy(zero_copy_only=False)
    length = np.array([len(k) // NAME for k in keys], np.int64)
    first = np.cumsum(length) - length
    rows, last = len(keys), len(keys) - 1
    names = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    total = np.concatenate([[0], np.cumsum(table.column("sizes").combine_chunks().flatten().to_numpy())]).astype(np.int64)
    before = lambda row, d: total[first[row] + np.maximum(d, 0)] - total[first[row]]  # noqa: E731  bytes of d turns

    local = _shared_with_previous(names, first, length)  # -1 for the block's first row
    lcp = local.copy()
    lcp[0] = left
    following = np.append(lcp[1:], right)
    whole = before(np.arange(rows), length)
    begun = whole - before(np.arange(rows), lcp)
    run = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int64)
    run_n, run_bytes, run_leaves, run_begun = run(n), run(n * whole), run(following < length), run(begun)

    # candidates: the prefixes that each row begins; the block's first row stands for all of its own
    count = length - local
    base = np.cumsum(count) - count
    row = np.repeat(np.arange(rows), count)
    depth = np.arange(count.sum()) - base[row] + local[row] + 1
    minima = RangeMinimum(local)
    lo, hi = minima.leftmost(row, depth), minima.rightmost(row, depth)
    smallest = RangeMinimum(least).of(lo, hi)
    members = run_n[hi + 1] - run_n[lo]
    own = depth > lcp[row]  # begun by this row, not by an earlier block
    up = before(row, depth - 1)
    distinct = run_begun[hi + 1] - run_begun[lo + 1] + np.where(own, whole[row] - up, begun[row])
    saved = run_bytes[hi + 1] - run_bytes[lo] - members * up - distinct

    # a row's first new prefix hangs from the prefix of the length it shares
    joins = np.flatnonzero(lcp >= 0)
    hangs = np.full(rows, -1, np.int64)
    at = minima.leftmost(joins, lcp[joins])
    hangs[joins] = base[at] + lcp[joins] - local[at] - 1
    children = np.bincount(hangs[joins], minlength=len(row)) + (own & (depth < length[row]))
    parent = np.where(depth == local[row] + 1, hangs[row], np.arange(len(row)) - 1)

    name = np.full(len(row), None, object)
    if left >= 0:
        name[: left + 1] = _prefix_digests(keys[0], left)
    opens = np.flatnonzero((hi == last) & (depth <= right))
    if len(opens):
        digests = _prefix_digests(keys[last], right)
        for i in opens:
            name[i] = digests[depth[i]]
    has = np.flatnonzero(depth > 0)
    parent_name, parent_id, known = np.full(len(row), None, object), np.zeros(len(row), np.int64), np.zeros(len(row), bool)
    parent_name[has] = name[parent[has]]
    known[has] = [x is None for x in parent_name[has]]
    parent_id[known] = smallest[parent[known]]
    here = own & (depth == length[row])
    end = np.full(len(row), None, object)
    end[here] = ends[row[here]]
    return pa.table({
        "conv_id": smallest, "depth": depth, "parent_conv_id": pa.array(parent_id, mask=~known), "n_convs": members,
        "n_children": children.astype(np.int64), "n_leaves": run_leaves[hi + 1] - run_leaves[lo], "saved_tokens": saved,
        "ends": pa.array(end, pa.string()), "node": pa.array(name, pa.binary()), "parent": pa.array(parent_name, pa.binary())})


def trie(rebuilt: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every node of the trie of ``rebuilt(conv_id, turns)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    parts = stored(blocks(sequences(rebuilt), block).groupBy("block").applyInArrow(block_nodes, NODE), "trie-parts")
    closed = parts.where("node is null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    open_ = stored(parts.where("node is not null").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums,
        F.max("ends").alias("ends"), F.max("parent").alias("parent")), "trie-open")
    above = open_.select(F.col("node").alias("of"), F.col("conv_id").alias("of_id"))
    columns: list[str | Column] = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                   "saved_tokens", "ends"]
    root = open_.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    hanging = closed.where("parent is not null").drop("parent_conv_id", "node").unionByName(
        open_.where("parent is not null").drop("node"))
    joined = hanging.join(above, F.col("parent") == F.col("of")).withColumn("parent_conv_id", F.col("of_id"))
    nodes = closed.where("parent is null").select(*columns).unionByName(root.select(*columns)).unionByName(joined.select(*columns))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.withColumn("ends_sha256", F.coalesce("ends", empty)).drop("ends")
