"""MinHash near-deduplication with ProbMinHash.

Every text is a weighted set of five-word shingles.  The arrivals of a Poisson
process per shingle, at the rate of its weight, fall on random registers; a
register keeps its first arrival.  A process is left as soon as its next
arrival is later than all registers of the document, so most shingles cost one
or two arrivals.  Two documents agree in a register with the probability of
their probability Jaccard similarity.  Registers are cut into bands; documents
that share a band are candidates, and candidates are verified exactly on their
texts.  Verified links are joined into classes.

Candidates without pairs of a whole bucket: equal texts are one vertex.  In
each bucket one member (the one that meets most others over all its buckets;
for a group of edited copies that is the original) is compared with the rest,
links become components, and only buckets that still hold several components
go on, with members of their smallest component as the next centres, sixteen
times as many each round.  A pair is left out only when both are in one component
already, so the classes are those of all verified candidate pairs.

Before a pair is made, a bound leaves out those that cannot be linked: shingles
found in one text only are in no partner, so their share, the difference in
length, and what each shares with the bucket's first centre, and a sketch of what
of the centre it lacks, limit the mass that
two texts can have in common (``_possible``).  In
a group of heavily edited copies this settles nearly all pairs without making
them, and no link is lost.

Weights are ``1 + ln(count)``.  Two texts are linked if the probability Jaccard
of these weights, or the plain Jaccard of the shingle sets, is at least 0.8.

Defined results: a text of fewer than five words is one shingle; null texts
and texts without words are in no group, their class is their own id; equal
texts are always in one class; a class is named by its smallest id; repeated
rows get equal rows.  Ids are expected to be unique: two texts under one id
are judged apart, but the classes they name share that number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blobs import groups, joined, pack
from .components import connected_components
from .tables import documents, stored
from .textbatch import U64, PrefixHash, Texts, mix, slices, unit

SHINGLE = 5
SIMILARITY = 0.8
#: a pair at 0.8 shares a band but for 7 in 100,000
BANDS, ROWS = 24, 5
#: 64-bit words of the sketch of a centre's shingles that a text lacks
LACK = 4


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of each distinct shingle, sorted."""
    start, end, doc = texts.words()
    if not len(start):
        return doc, np.zeros(0, U64), np.zeros(0)
    word = PrefixHash(texts.data).of(start, end)
    n = np.bincount(doc, minlength=texts.n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.arange(len(word)) - first[doc]
    length = np.minimum(n[doc], SHINGLE)
    heads = np.flatnonzero(at + length <= n[doc])
    gram = np.zeros(len(heads), U64)
    for step in range(SHINGLE):
        more = step < length[heads]
        gram[more] = mix(gram[more] * U64(3) + word[heads[more] + step], 5)
    doc = doc[heads]
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(doc)))
    return doc[at], gram[at], 1.0 + np.log(count)


def registers(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash: the shingle that arrives first in each of ``size`` registers.

    One round draws the next arrival of every process still running.
    """
    first = np.full(n * size, np.inf)
    winner = np.zeros(n * size, U64)
    time = np.zeros(len(doc))
    arrival = 0
    while len(doc):
        time = time - np.log(unit(mix(gram, 100 + 2 * arrival))) / weight
        cell = doc * size + (mix(gram, 101 + 2 * arrival) % U64(size)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        winner[cell[won]] = gram[won]
        latest = first.reshape(n, size).max(axis=1)
        running = time < latest[doc]
        doc, gram, weight, time = doc[running], gram[running], weight[running], time[running]
        arrival += 1
    return winner.reshape(n, size)


def band_keys(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(winner), bands), U64)
    for r in range(rows):
        keys = mix(keys * U64(3) + winner[:, r::rows][:, :bands], 11)
    return mix(keys + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15), 12)


def vertices(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(v, doc_id, n, bands)`` of each distinct text with words, stored.

    ``v`` is the text's SHA-256 cut to 128 bits, ``doc_id`` the smallest id
    that has the text, in ``n`` rows.  Texts are read once and not shuffled.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column("doc_id"), batch.column("v")
            for texts in slices(batch.column("text")):
                doc, gram, weight = shingles(texts)
                keys = band_keys(registers(doc, gram, weight, texts.n, bands * rows), bands, rows).view(np.int64)
                some = np.bincount(doc, minlength=texts.n) > 0
                at = pa.array(np.flatnonzero(some) + texts.first)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (len(at) + 1) * bands, bands, dtype=np.int32)), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(at), v.take(at), lists], ["doc_id", "v", "bands"])

    signed = documents(docs).select("doc_id", _vertex(), "text").mapInArrow(
        sign, "doc_id long, v string, bands array<long>")
    of_id = signed.groupBy("v", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("least")
    return stored(of_id.groupBy("v").agg(least, F.first("bands").alias("bands"))
                  .select("v", "least.doc_id", "least.n", "bands"), "vertices")


def _vertex():
    return F.left(F.sha2(F.col("text"), 256), F.lit(32)).alias("v")


def members(signed: DataFrame) -> DataFrame:
    """``(bucket, v, degree)`` of the buckets that several vertices share, stored.

    ``degree`` is how many vertices one meets over all its buckets.
    """
    buckets = signed.select(F.explode("bands").alias("bucket"), "v")
    shared = (buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .withColumnRenamed("bucket", "shared"))
    rows = stored(buckets.join(shared, F.col("bucket") == F.col("shared")).select("bucket", "v", "n"), "buckets")
    degree = rows.groupBy("v").agg(F.sum("n").alias("degree")).withColumnRenamed("v", "w")
    return stored(rows.join(degree, F.col("v") == F.col("w")).select("bucket", "v", "degree"), "members")


def novelty(texts: DataFrame) -> DataFrame:
    """``(v, s, w, u, uw)``: number and weight of a text's shingles, and of
    those that no other candidate text has.  Shingles go packed by hash bucket.
    """
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = int(total // (12 << 20)) + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("v").to_pylist(), "S32")
            parts = []
            for run in slices(batch.column("text")):
                doc, gram, weight = shingles(run)
                parts.append((doc + run.first, gram, weight.astype(np.float32)))
            doc, gram, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = (gram % U64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            starts, bounds = groups(of[order])
            cells = []
            for a, b in zip(starts, bounds[1:], strict=True):
                i = order[a:b]
                used, at = np.unique(doc[i], return_inverse=True)
                cells.append(pack(gram[i], at.astype(np.int32), weight[i], names[used]))
            yield pa.RecordBatch.from_arrays([pa.array(of[order[starts]]), pa.array(cells, pa.binary())],
                                             ["bucket", "cell"])

    def count(bucket: pa.Table) -> pa.Table:
        gram, doc, weight, name, first = [], [], [], [], 0
        for cell in bucket.column("cell").to_pylist():
            g, d, w, v = joined([cell], "u8", "i4", "f4", "S32")
            gram.append(g), doc.append(d + first), weight.append(w), name.append(v)
            first += len(v)
        gram, doc, weight, name = map(np.concatenate, (gram, doc, weight, name))
        order = np.argsort(gram)
        _, bounds = groups(gram[order])
        alone = np.zeros(len(gram), bool)
        alone[order] = np.repeat(np.diff(bounds), np.diff(bounds)) == 1
        n = len(name)
        return pa.table({"v": pa.array(name.astype("U32")), "s": np.bincount(doc, minlength=n),
                         "w": np.bincount(doc, weight, n).astype(np.float64), "u": np.bincount(doc[alone], minlength=n),
                         "uw": np.bincount(doc[alone], weight[alone], n).astype(np.float64)})

    parts = (texts.select("v", "text").mapInArrow(send, "bucket long, cell binary")
             .groupBy("bucket").applyInArrow(count, "v string, s long, w double, u long, uw double"))
    return parts.groupBy("v").agg(*[F.sum(c).alias(c) for c in ("s", "w", "u", "uw")])


def _limits(suffix: str = "") -> list[Column]:
    """What ``_possible`` needs of a text, from s, w, u, uw, m and lack; no column is null.

    ``share`` and ``share_w`` are number and weight of the shingles that others have too,
    ``extra`` what the weight is over the number, ``beside`` the shared shingles
    that are not the centre's.  An unknown m is no limit.
    """
    c, unknown, zero = F.col, F.lit(1 << 40), F.lit(0).cast("long")
    out = {"s": F.coalesce("s", zero), "w": F.coalesce("w", F.lit(0.0)), "share": F.coalesce(c("s") - c("u"), zero),
           "share_w": F.coalesce(F.greatest(c("w") - c("uw"), F.lit(1e-9)), F.lit(1e-9)),
           "extra": F.coalesce(c("w") - c("s"), F.lit(0.0)), "m": F.coalesce("m", unknown),
           "beside": F.coalesce(F.greatest(c("s") - c("m") - c("u"), zero), unknown)}
    out |= {f"lack{i}_": F.coalesce(c("lack")[i], zero) for i in range(LACK)}
    return [x.alias(name + suffix) for name, x in out.items()]


def _possible(similarity: float) -> Column:
    """Can x and y (``_limits`` and ``_limits("2")``) be linked at all?

    m is what a text has in common with its bucket's first centre, ``lack`` a
    bitmap of the hashes of the centre's other shingles.  Every bit that only y's
    ``lack`` has set stands for a shingle that x has and y lacks, so of the
    centre's shingles two texts share at most one text's m less the bits that only
    the other's sets; of all others at most those that are not one text's own.

    With common mass at most a in x and b in y, the probability Jaccard is at
    most ``ab / (a + b - ab)``: every term of its sum is a concave function,
    homogeneous in the two masses, so the sum is at most its value at the
    totals.  a misses x's own shingles, and as many as x has over those that can
    be common (each weighs 1 or more).  The same holds with all weights 1 for the
    plain Jaccard.

    The join tries this on every pair of a member and a centre: it is kept short.
    """
    c = F.col

    def only(one: str, other: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(c(f"lack{i}_{one}").bitwiseAND(F.bitwise_not(c(f"lack{i}_{other}"))))
                                       for i in range(LACK)])

    of_centre = F.least(c("m") - only("2", ""), c("m2") - only("", "2"))
    common = F.greatest(F.lit(1e-9), F.least("share", "share2", of_centre + F.least("beside", "beside2")).cast("double"))
    fits = F.lit(1 + 1 / similarity + 1e-9)
    return (((c("s") + c("s2")) <= fits * common)
            | (c("w") / F.least("share_w", c("extra") + common)
               + c("w2") / F.least("share_w2", c("extra2") + common) <= fits))


def similarities(a: Texts, b: Texts) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two single texts."""
    return _compare(shingles(a)[1:], shingles(b)[1:])[:2]


def _sketch(gram: np.ndarray) -> np.ndarray:
    """LACK words with a bit set for each shingle, by its hash."""
    at = mix(gram, 13) % U64(64 * LACK)
    words = np.zeros(LACK, U64)
    np.bitwise_or.at(words, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return words


def _compare(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, int]:
    """Probability Jaccard, plain Jaccard, number of common shingles."""
    (ga, wa), (gb, wb) = a, b
    both, ia, ib = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
    union = len(ga) + len(gb) - len(both)
    if not len(both):
        return 0.0, 0.0, 0
    # sum over the common x of 1 / sum_y max(wa(y)/wa(x), wb(y)/wb(x)): in the
    # order of wa/wb every y takes its share of a on one side of x, of b on the other
    xa, xb = wa[ia], wb[ib]
    order = np.argsort(xa / xb, kind="stable")
    xa, xb = xa[order], xb[order]
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    from_here = only_a + np.cumsum(xa[::-1])[::-1]
    before = only_b + np.concatenate([[0.0], np.cumsum(xb)[:-1]])
    return float((1.0 / (from_here / xa + before / xb)).sum()), len(both) / union, len(both)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b, similar, common, a_only, b_only)`` of the pairs, the last two sketches
    of the shingles that only one has.  ``a`` may be in very many pairs:
    its rows are split by adaptive skew handling, its text is one row."""
    left = pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
    full = left.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            name_a, name_b = batch.column("a"), batch.column("b")
            keep, common = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64)
            only = np.zeros((2, len(batch), LACK), U64)
            row = 0
            for run in slices(batch.column("text_b")):
                doc, gram, weight = shingles(run)
                edge = np.searchsorted(doc, np.arange(run.n + 1))
                for i in range(run.n):
                    if name_a[row].as_py() != last:
                        last = name_a[row].as_py()
                        last_set = shingles(next(slices(batch.column("text_a").slice(row, 1))))[1:]
                    own = slice(edge[i], edge[i + 1])
                    probable, plain, common[row] = _compare(last_set, (gram[own], weight[own]))
                    keep[row] = max(probable, plain) >= similarity
                    only[0, row] = _sketch(np.setdiff1d(last_set[0], gram[own], assume_unique=True))
                    only[1, row] = _sketch(np.setdiff1d(gram[own], last_set[0], assume_unique=True))
                    row += 1
            offsets = pa.array(np.arange(0, (len(batch) + 1) * LACK, LACK, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [name_a, name_b, pa.array(keep), pa.array(common),
                 *[pa.ListArray.from_arrays(offsets, pa.array(x.ravel().view(np.int64))) for x in only]],
                ["a", "b", "similar", "common", "a_only", "b_only"])

    return (full.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
            .mapInArrow(similar, "a string, b string, similar boolean, common long, "
                                 "a_only array<long>, b_only array<long>"))


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS,
            similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``(vertices, components)``: distinct texts, and ``(v, component)`` of linked ones."""
    spark = docs.sparkSession
    signed = vertices(docs, bands, rows)
    left = members(signed)
    wanted = left.select("v").distinct().join(signed.select("v", F.col("doc_id").alias("m")), "v")
    texts = documents(docs).select(_vertex(), "doc_id", "text").join(
        wanted.withColumnRenamed("v", "w"), (F.col("v") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("m")))
    texts = stored(texts.select("v", "text").dropDuplicates(["v"]), "candidate-texts")
    empty = spark.createDataFrame([], "a string, b string")
    # a text of which more than the rest to 0.8 is its own has no partner
    left = stored(left.join(stored(novelty(texts), "novelty"), "v")
                  .where(F.least(F.col("uw") / F.col("w"), F.col("u") / F.col("s")) <= 1 - similarity + 1e-9), "members")
    left = left.withColumns({"m": F.lit(None).cast("long"), "lack": F.lit(None).cast("array<long>")})
    facts = ["s", "w", "u", "uw", "m", "lack"]
    edges, checked = empty, empty
    component = spark.createDataFrame([], "node string, component string")
    centres = 1
    while True:
        # buckets whose remaining members are not all in one component
        state = (left.join(component, F.col("v") == F.col("node"), "left")
                 .select("bucket", "v", "degree", *facts, F.coalesce("component", "v").alias("c")))
        open_ = (state.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
                 .where("lo <> hi").select(F.col("bucket").alias("open")))
        state = stored(state.join(open_, F.col("bucket") == F.col("open")).drop("open"), "open-buckets")
        if state.isEmpty():
            break
        size = state.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("bucket").orderBy("n", F.col("degree").desc(), "v")
        chosen = stored(state.join(size, ["bucket", "c"]).withColumn("rank", F.row_number().over(order))
                        .where(F.col("rank") <= centres)
                        .select(F.col("bucket").alias("shared"), F.col("v").alias("centre"), F.col("c").alias("own"),
                                *_limits("2")), "centres")
        pairs = (state.select("bucket", "v", "c", *_limits()).join(chosen, (F.col("bucket") == F.col("shared")) & (F.col("c") != F.col("own"))
                            & _possible(similarity))
                 .select(F.least("centre", "v").alias("lo"), F.greatest("centre", "v").alias("hi"),
                         F.col("centre").alias("a"), F.col("v").alias("b"))
                 .groupBy("lo", "hi").agg(F.max(F.struct("a", "b")).alias("p")).select("p.*", "lo", "hi"))
        pairs = pairs.join(checked.select(F.col("a").alias("lo"), F.col("b").alias("hi")), ["lo", "hi"], "left_anti")
        pairs = stored(pairs, "pairs")
        checked = checked.unionByName(pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        seen = stored(verify(pairs.select("a", "b"), texts, similarity), "compared")
        new = seen.where("similar").select("a", "b")
        if not new.isEmpty():
            edges = edges.unionByName(new)
            component = stored(connected_components(edges), "components")
        # a centre has met every member of its bucket
        left = stored(state.drop("c").join(
            chosen.select("shared", "centre"),
            (F.col("bucket") == F.col("shared")) & (F.col("v") == F.col("centre")), "left_anti"), "members")
        if centres == 1:  # what each member has in common with its bucket's first centre, and what it lacks
            met = seen.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "a", "common", "a_only", "b_only")
            lack = F.when(F.col("a") == F.col("centre"), F.col("a_only")).otherwise(F.col("b_only"))
            left = stored(left.drop("m", "lack").join(chosen.select("shared", "centre"), F.col("bucket") == F.col("shared"))
                          .withColumns({"lo": F.least("v", "centre"), "hi": F.greatest("v", "centre")})
                          .join(met, ["lo", "hi"], "left")
                          .select("bucket", "v", "degree", "s", "w", "u", "uw", F.col("common").alias("m"),
                                  lack.alias("lack")), "members")
        centres *= 16
    return signed, component.select(F.col("node").alias("v"), "component")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS,
                    similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id)`` of every document; ``class_id`` is the smallest id of its class."""
    signed, component = classes(docs, bands, rows, similarity)
    named = class_ids(signed, component)
    return (documents(docs).select("doc_id", _vertex())
            .join(named.select(F.col("v").alias("w"), "class_id"), F.col("v") == F.col("w"), "left")
            .select("doc_id", F.when(F.col("w").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")))


def class_ids(signed: DataFrame, component: DataFrame) -> DataFrame:
    """``(v, doc_id, n, class_id, first)``: ``first`` is the vertex that stays."""
    of = signed.select("v", "doc_id", "n").join(component, "v", "left").withColumn(
        "component", F.coalesce("component", "v"))
    least = of.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")).alias("least"))
    return of.join(least, "component").select(
        "v", "doc_id", "n", F.col("least.doc_id").alias("class_id"), (F.col("least.v") == F.col("v")).alias("first"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, all columns kept."""
    signed, component = classes(docs)
    stay = stored(class_ids(signed, component).where("first").select(
        F.col("v").alias("__w"), F.col("doc_id").alias("__m"), F.col("n").alias("__n")), "stay")
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").cast("long").alias("__id"),
                         F.left(F.sha2(F.col("text"), 256), F.lit(32)).alias("__v"),
                         F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("__has"))
    alone = packed.where(~F.col("__has")).select("__row.*")
    grouped = packed.where("__has").join(
        stay, (F.col("__v") == F.col("__w")) & F.col("__id").eqNullSafe(F.col("__m")))
    # equal rows under the smallest id: one of them stays (both branches share one exchange)
    once = grouped.where("__n = 1").select("__row.*")
    one_of = grouped.where("__n > 1").dropDuplicates(["__v"]).select("__row.*")
    return alone.unionByName(once).unionByName(one_of)
