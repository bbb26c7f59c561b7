"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's fingerprint has a bit set if over half of its three-word shingles
(repeats counted) have it set in their XXH64.  Fingerprints that differ in two
bits or fewer are linked.

Candidates come from keys that tolerate errors.  The 64 bits are cut into three
segments (22, 21 and 21 bits).  Two errors leave one segment as it is, and the
segment after it has two errors at most.  That segment is read as a word of the
perfect binary Golay code [23,12,7] and decoded to the 12-bit indices of all
codewords within distance 4, some five of them.  Two words at distance 2 have a
word between them at distance 1 from both; the codeword within 3 of that word
is within 4 of both, so the two share an index.  (Unchanged segment, index)
is hence a key that any two linked fingerprints share.  A fingerprint has some
sixteen keys; those that share one are compared bit by bit.

A key with more than ``MOST_PAIRED`` fingerprints makes no pairs.  Its
fingerprints go to hubs instead: themselves and the 64 words one bit away.  Two
fingerprints that differ in two bits or fewer meet at a hub, all that meet at
one are within two bits of each other, and a hub has 65 members at most, so
each is tied to the smallest.  Nothing is capped or lost either way.

Equal fingerprints are one vertex before any key is made, so a group of copies
of any size is one row.

Defined results: null texts and texts without words have fingerprint zero and
are linked like any other; a text of one or two words is one shingle; rows
that share an id are judged apart but share a component only if their
fingerprints do; a null id keeps its row, and a component that only null ids
reach has none.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import documents, stored

SHINGLE = 3
SEED = 42
#: bits differing between linked fingerprints
DISTANCE = 2
SEGMENTS = (22, 21, 21)
#: keys with more fingerprints than this go by hubs instead of pairs
MOST_PAIRED = 32

#: fixed values: generator polynomial and length of the perfect Golay code
GOLAY_GENERATOR = 0b110001110101
GOLAY_LENGTH = 23
GOLAY_CHECKS = 11

#: bytes of a text whose words are held at once, and shingles hashed at once
PIECE = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some ``PIECE`` bytes at a time, cut between words."""
    at = 0
    while at < len(text):
        cut = SPACES.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        if words:
            yield words
        at = end + 1


def _shingles(text: bytes) -> Iterator[list[bytes]]:
    """Shingles of a text in runs, repeats included."""
    tail: list[bytes] = []
    any_full = False
    for words in _pieces(text):
        words = tail + words
        if len(words) >= SHINGLE:
            any_full = True
            joined = b" ".join(words)
            ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
            starts = [0, *[e + 1 for e in ends[:-1]]]
            yield [joined[a:b] for a, b in zip(starts, ends[SHINGLE - 1:], strict=False)]
        tail = words[1 - SHINGLE:]
    if tail and not any_full:
        yield [b" ".join(tail)]


def fingerprint(text: bytes | None) -> int:
    """Majority of the shingles' hash bits, unsigned; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for run in _shingles((text or b"").translate(LOWER)):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in run), np.uint64, len(run))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
        n += len(run)
    return sum(1 << b for b in range(64) if 2 * int(ones[b]) > n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fp = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return documents(docs).mapInArrow(sign, "doc_id long, fp long")


def _remainder(word: int) -> int:
    for bit in range(GOLAY_LENGTH - 1, GOLAY_CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GOLAY_GENERATOR << (bit - GOLAY_CHECKS)
    return word


class Golay:
    """All codewords within distance 4 of a word, by its syndrome.

    The code is cyclic and systematic: a word's upper 12 bits name its codeword,
    its lower 11 bits are the remainder of what is above them.  Each of the
    2,048 syndromes has its error patterns of four bits or fewer.
    """

    def __init__(self, distance: int = 4):
        self.upper = np.array([_remainder(m << GOLAY_CHECKS) for m in range(1 << (GOLAY_LENGTH - GOLAY_CHECKS))], np.int64)
        errors = np.array([sum(1 << b for b in bits) for n in range(distance + 1)
                           for bits in itertools.combinations(range(GOLAY_LENGTH), n)], np.int64)
        of = self.syndrome(errors)
        order = np.argsort(of, kind="stable")
        self.errors = errors[order]
        self.first = np.searchsorted(of[order], np.arange((1 << GOLAY_CHECKS) + 1))

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.upper[words >> GOLAY_CHECKS] ^ (words & ((1 << GOLAY_CHECKS) - 1))

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each (word, codeword) and the codeword's 12-bit index."""
        s = self.syndrome(words)
        n = self.first[s + 1] - self.first[s]
        row = np.repeat(np.arange(len(words)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[s], n)
        return row, (words[row] ^ self.errors[at]) >> GOLAY_CHECKS


def fuzzy_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each fingerprint (uint64): segment, its bits, index of the next one."""
    shift = np.concatenate([[0], np.cumsum(SEGMENTS)])
    parts = [((fp >> np.uint64(shift[i])) & np.uint64((1 << w) - 1)).astype(np.int64) for i, w in enumerate(SEGMENTS)]
    rows, keys = [], []
    for i in range(len(SEGMENTS)):
        row, index = golay.indices(parts[(i + 1) % len(SEGMENTS)])
        rows.append(row)
        keys.append((np.int64(i) << 40) | (parts[i][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def keyed(vertices: DataFrame) -> DataFrame:
    """``(key, fp)``: every fuzzy key of the distinct fingerprints."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(fp.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return vertices.select("fp").mapInArrow(emit, "key long, fp long")


def hub_links(members: DataFrame) -> DataFrame:
    """``(a, b)`` ties of distinct fingerprints that meet at a word one bit away or less."""
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)),
                                                                 lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    at_hub = members.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    met = at_hub.groupBy("hub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    return (met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b")
            .select("a", "b").distinct())


def links(vertices: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """``(a, b)`` edges that join all distinct fingerprints within ``DISTANCE`` bits."""
    keys = stored(keyed(vertices), "golay-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "k")
    met = stored(keys.join(shared, F.col("key") == F.col("k")).select("key", "fp", "n"), "golay-shared")
    few = met.where(F.col("n") <= most_paired)
    other = few.select(F.col("key").alias("k"), F.col("fp").alias("fp2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE
    pairs = few.join(other, (F.col("key") == F.col("k")) & (F.col("fp") < F.col("fp2")) & near)
    many = met.where(F.col("n") > most_paired).select("fp").distinct()
    return pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct().unionByName(hub_links(many))


def near_duplicates(docs: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest doc_id that links of two bits or fewer reach.
    """
    signed = stored(fingerprints(docs), "fingerprints")
    vertices = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "vertices")
    component = connected_components(links(vertices, most_paired))
    of = vertices.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.select("fp", "component").join(least, "component").select(F.col("fp").alias("f"), "component_id")
    return signed.join(named, F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
