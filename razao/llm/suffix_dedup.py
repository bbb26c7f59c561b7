"""Exact removal of repeated passages by a sparse suffix sort.

A byte is removed if a ``WINDOW``-byte string that covers it also starts in a
document with a smaller id.  Strings are judged on the input.

1. Anchors.  Every window has one anchor, the ANCHOR-byte string in it with the
   smallest hash (the leftmost of equal ones).  It depends on the window's bytes
   alone, so equal windows in two documents have equal anchors at equal places.
   Consecutive windows with one anchor make a segment.  Only (anchor hash,
   segment hash, place) is shuffled, packed by anchor bucket: one entry for some
   18 windows.
   Of equal segments of one flush only the first holder's goes there; the
   others are known to repeat and go straight to their documents.
2. A segment that equals one of a smaller id is repeated as a whole.  What is
   left undecided are the first holders of segments whose anchor has other
   segments too.  An anchor with very many contexts (``_hot``) is dealt by the
   whole segment here and by the whole window in step 3, where again a flush
   sends only the first holder of a window; so no anchor is one task.
3. Their suffixes are sorted, all groups of an anchor at once: by 8 bytes, then
   those that still agree by the next 8.  Neighbours of one prefix polynomial hash
   that agree in WINDOW bytes, verified byte by byte, form a class; all but its
   smallest id repeat.

Verdicts go to the documents packed, a cell for each group of documents, and are
stored; what step 1 shuffled is then freed.  The texts are shuffled once: both
joins, with the undecided segments and with the removed runs, read one exchange.

Defined results: a null text is empty; ids are compared as numbers and a null
id comes after all others; rows that share an id do not remove from each other;
texts shorter than WINDOW bytes stay whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import groups, joined, pack, unpack
from .tables import small_batches, stored
from .textbatch import U64, PrefixHash, Texts, mix, slices

WINDOW = 50
ANCHOR = 16
#: a null id, in comparisons
LAST = (1 << 63) - 1
#: bytes of text whose anchors make one bucket, and go out in one packed row a bucket
BUCKET_BYTES = 12 << 20
FLUSH_BYTES = 12 << 20
#: longer texts are cut into pieces that overlap by WINDOW - 1 bytes
PIECE = 2 << 20

_PLACE = (1 << 24) - 1
_48 = U64((1 << 48) - 1)
_ENTRY = ("u8", "u8", "i4", "i4", "u1", "i8", "i4")
#: repeats on their way to their documents, in groups of negative numbers
_KNOWN = ("i8", "i4", "i4", "i4")
#: spans of a group of documents: document, first window, windows, anchor (undecided ones), ids and keys
_REPEATS = ("i4", "i4", "u1", "i8", "i4")
_OPEN = ("i4", "i4", "u1", "u8", "i8", "i4")
#: an anchor is hot with so many contexts in one of SAMPLE texts; at most MOST_HOT are
SAMPLE, HOT_CONTEXTS, MOST_HOT = 64, 8, 100_000
#: segments met so often in a flush are remembered by the task, so many at most
OFTEN, MOST_SEEN = 4, 100_000
#: bytes of undecided segments sorted at once (one anchor's at least)
SORT_BYTES = 1 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """``ord`` orders documents, ``key`` tells rows apart that share an id."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
                       F.hash("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (block minima from both sides)."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, U64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1: width - 1 + n])


def segments(texts: Texts) -> tuple[np.ndarray, ...]:
    """anchor hash, segment hash, document, first window, number of windows."""
    none = tuple(np.zeros(0, d) for d in (U64, U64, np.int64, np.int64, np.int64))
    data = texts.data
    n = len(data)
    if n < WINDOW:
        return none
    hashes = PrefixHash(data)
    at = np.arange(n - ANCHOR + 1)
    grams = mix(hashes.raw(at, at + ANCHOR), 21)
    low = _sliding_min((grams & ~U64(_PLACE)) | at.astype(U64), WINDOW - ANCHOR + 1)
    size = np.diff(texts.offsets)
    long_ = size >= WINDOW
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, texts.offsets[:-1][long_], 1)
    np.add.at(step, (texts.offsets[1:] - WINDOW + 1)[long_], -1)
    valid = np.cumsum(step)[: len(low)] > 0
    anchor = (low & U64(_PLACE)).astype(np.int64)
    anchor[~valid] = -1
    change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    stop = np.append(change[1:], len(anchor))
    real = anchor[change] >= 0
    lo, hi, anchor = change[real], stop[real], anchor[change[real]]
    if not len(lo):
        return none
    whole = mix(hashes.raw(lo, hi + WINDOW - 1) + (hi - lo).astype(U64), 22) ^ mix((anchor - lo).astype(U64), 23)
    return grams[anchor] & _48, whole & _48, texts.doc_of(lo), lo, hi - lo


def _pieces(texts: Texts) -> Iterator[tuple[Texts, int]]:
    """Runs of documents, or one long text cut up so that windows are cut apart."""
    if len(texts.data) <= PIECE or texts.n != 1:
        yield texts, 0
        return
    for start in range(0, len(texts.data) - WINDOW + 1, PIECE):
        part = texts.data[start: start + PIECE + WINDOW - 1]
        yield Texts(part, np.array([0, len(part)]), texts.first), start


def _hot(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the anchors with the most contexts, from one of SAMPLE texts.

    They only tell by which key an anchor's entries are dealt; results are the
    same whatever is in the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_ in slices(batch.column("text"), PIECE):
                for texts, _ in _pieces(run_):
                    ah, sh = segments(texts)[:2]
                    order = np.lexsort((sh, ah))
                    ah, sh = ah[order], sh[order]
                    new = np.append(True, (ah[1:] != ah[:-1]) | (sh[1:] != sh[:-1])) if len(ah) else np.zeros(0, bool)
                    starts, bounds = groups(ah[new])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ah[new][starts].view(np.int64)), pa.array(np.diff(bounds).astype(np.int64))], ["ah", "n"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = some.mapInArrow(run, "ah long, n long").groupBy("ah").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= HOT_CONTEXTS).orderBy(F.col("n").desc(), "ah").limit(MOST_HOT).collect()
    return np.sort(np.array([r["ah"] for r in rows], np.int64).view(U64))


def _is_hot(ah: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(ah), bool)
    return hot[np.minimum(np.searchsorted(hot, ah), len(hot) - 1)] == ah


def _known(ord_: np.ndarray, key: np.ndarray, lo: np.ndarray, cnt: np.ndarray) -> tuple[int, bytes]:
    """Group number and cell of spans that are known to repeat: a group for each flush."""
    order = np.lexsort((lo, key, ord_))
    ord_, key, lo, cnt = (x[order] for x in (ord_, key, lo, cnt))
    name = mix(ord_[-1:].view(U64) ^ mix(ord_[:1].view(U64) + lo[:1].astype(U64)), 24)
    return -1 - int(name[0] >> U64(2)), pack(ord_, key, lo.astype(np.int32), cnt.astype(np.int32))


def _cells(numbered: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in numbered], pa.int64()),
                                       pa.array([c for _, c in numbered], pa.binary())], ["bucket", "cell"])


def _anchored(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """``(bucket, cell)``: packed anchors, a row for each bucket and some 12 MB of text.

    Of equal segments in one flush only the smallest id's are sent to be
    compared; the others are known to repeat and go to a group of their flush,
    in no bucket.  A task remembers what it met OFTEN, so a passage that very
    many documents hold takes one entry a task and one for each smaller id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, held_bytes, n_docs = [], [], 0, 0
        seen = (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, names, held_bytes, n_docs, seen
            ah, sh, doc, lo, cnt = (np.concatenate(x) for x in zip(*held, strict=True))
            ords, keys = (np.concatenate(x) for x in zip(*names, strict=True))
            held, names, held_bytes, n_docs = [], [], 0, 0
            if not len(ah):
                return
            n = len(ah)
            ah, sh = np.concatenate([ah, seen[0]]), np.concatenate([sh, seen[1]])
            ord_ = np.concatenate([ords[doc], seen[2]])
            order = np.lexsort((ord_, sh, ah))
            ah, sh, ord_ = ah[order], sh[order], ord_[order]
            new = np.concatenate([[True], (ah[1:] != ah[:-1]) | (sh[1:] != sh[:-1])])
            number, at = np.cumsum(new) - 1, np.flatnonzero(new)
            times = np.bincount(number, np.where(order < n, 1, OFTEN))
            often = np.flatnonzero(times >= OFTEN)
            often = at[often[np.argsort(-times[often], kind="stable")[:MOST_SEEN]]]
            seen = (ah[often], sh[often], ord_[often])
            own = order < n
            repeat = (ord_ > ord_[at][number])[own]
            ah, sh, i = ah[own], sh[own], order[own]
            doc, lo, cnt = doc[i], lo[i], cnt[i]
            out = []
            if repeat.any():
                out.append(_known(ords[doc[repeat]], keys[doc[repeat]], lo[repeat], cnt[repeat]))
            ah, sh, doc, lo, cnt = (x[~repeat] for x in (ah, sh, doc, lo, cnt))
            of = (np.where(_is_hot(ah, hot), mix(ah ^ mix(sh, 25), 26), ah) % U64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            starts, bounds = groups(of[order])
            for a, b in zip(starts, bounds[1:], strict=True):
                i = order[a:b]
                used, at = np.unique(doc[i], return_inverse=True)
                out.append((int(of[order[a]]),
                            pack(ah[i], sh[i], at.astype(np.int32), lo[i], cnt[i], ords[used], keys[used])))
            yield _cells(out)

        for batch in batches:
            ords = batch.column("ord").to_numpy()
            keys = batch.column("key").to_numpy()
            for run_ in slices(batch.column("text"), PIECE):
                for texts, start in _pieces(run_):
                    ah, sh, doc, lo, cnt = segments(texts)
                    held.append((ah, sh, doc + texts.first - run_.first + n_docs,
                                 (lo - texts.offsets[doc] + start).astype(np.int32), cnt.astype(np.uint8)))
                    held_bytes += len(texts.data)
                names.append((ords[run_.first: run_.first + run_.n], keys[run_.first: run_.first + run_.n]))
                n_docs += run_.n
                if held_bytes >= FLUSH_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select("ord", "key", "text").mapInArrow(run, "bucket long, cell binary")


_CELLS = "open boolean, part long, cell binary"


def _to_docs(ord_: np.ndarray, key: np.ndarray, lo: np.ndarray, cnt: np.ndarray, parts: int,
             ah: np.ndarray | None = None) -> pa.Table:
    """A packed row for each of ``parts`` groups of documents: undecided segments, or repeats without ``ah``."""
    part = (mix(ord_.view(U64) ^ mix(key.astype(U64), 28), 29) % U64(parts)).astype(np.int64)
    order = np.lexsort((lo, key, ord_, part))
    ord_, key, part = ord_[order], key[order], part[order]
    new = np.append(True, (ord_[1:] != ord_[:-1]) | (key[1:] != key[:-1])) if len(ord_) else np.zeros(0, bool)
    planes = [lo[order].astype(np.int32), cnt[order].astype(np.uint8)]
    if ah is not None:
        planes.append(ah[order].astype(U64))
    starts, bounds = groups(part)
    cells = []
    for a, b in zip(starts, bounds[1:], strict=True):
        fresh = np.append(True, new[a + 1: b])
        cells.append(pack((np.cumsum(fresh) - 1).astype(np.int32), *[x[a:b] for x in planes],
                          ord_[a:b][fresh], key[a:b][fresh].astype(np.int32)))
    return pa.Table.from_arrays([pa.array(np.full(len(cells), ah is not None)), pa.array(part[starts]),
                                 pa.array(cells, pa.binary())], ["open", "part", "cell"])


def _spans(cells: pa.ChunkedArray, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    """What ``_to_docs`` packed: id, key, first window, windows (and anchor), ordered by document and place."""
    parts = [unpack(c.as_buffer(), *dtypes) for c in cells]
    out = [np.concatenate([p[i][p[0]] for p in parts]) for i in (-2, -1)]
    out += [np.concatenate([p[i] for p in parts]) for i in range(1, len(dtypes) - 2)]
    order = np.lexsort((out[2], out[1], out[0]))
    return [x[order] for x in out]


def _open_by_doc(group: pa.Table) -> pa.Table:
    """The undecided segments of a group of documents, one row a document."""
    ord_, key, lo, cnt, ah = _spans(group.column("cell"), _OPEN)
    new = np.flatnonzero(np.append(True, (ord_[1:] != ord_[:-1]) | (key[1:] != key[:-1])))
    offsets = pa.array(np.append(new, len(ord_)).astype(np.int32))
    return pa.Table.from_arrays(
        [pa.array(ord_[new]), pa.array(key[new])]
        + [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (lo, cnt.astype(np.int32), ah.astype(np.int64))],
        ["o", "k", "lo", "cnt", "ah"])


def _runs_by_doc(group: pa.Table) -> pa.Table:
    """Maximal removed runs of a group of documents, one row a document."""
    ord_, key, lo, cnt = _spans(group.column("cell"), _REPEATS)
    new = np.append(True, (ord_[1:] != ord_[:-1]) | (key[1:] != key[:-1]))
    shift = np.cumsum(new) << 32  # documents one after the other
    begin = shift + lo
    end = np.maximum.accumulate(begin + cnt + (WINDOW - 1))
    first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    last = np.append(first[1:], len(lo)) - 1
    doc = np.flatnonzero(new[first])
    offsets = pa.array(np.append(doc, len(first)).astype(np.int32))
    runs = [pa.array((x - shift[first]).astype(np.int32)) for x in (begin[first], end[last])]
    return pa.Table.from_arrays([pa.array(ord_[first][doc]), pa.array(key[first][doc])]
                                + [pa.ListArray.from_arrays(offsets, r) for r in runs], ["o", "k", "begin", "end"])


def _told(bucket: pa.Table, parts: int) -> pa.Table | None:
    """The repeats of a group that holds known ones."""
    if bucket.column("bucket")[0].as_py() >= 0:
        return None
    return _to_docs(*joined((c.as_buffer() for c in bucket.column("cell")), *_KNOWN), parts)


def _judge_segments(bucket: pa.Table, parts: int, hot: np.ndarray) -> pa.Table:
    """Whole segments of one anchor bucket: repeats, and what is undecided."""
    told = _told(bucket, parts)
    if told is not None:
        return told
    sent = [unpack(c.as_buffer(), *_ENTRY) for c in bucket.column("cell")]
    ah, sh, lo, cnt = (np.concatenate([p[i] for p in sent]) for i in (0, 1, 3, 4))
    ord_, key = (np.concatenate([p[i][p[2]] for p in sent]) for i in (5, 6))
    del sent
    order = np.lexsort((ord_, sh, ah))
    ah, sh, ord_, key, lo, cnt = (x[order] for x in (ah, sh, ord_, key, lo, cnt))
    if not len(ah):
        return _to_docs(ord_, key, lo, cnt, parts)
    new_anchor = np.concatenate([[True], ah[1:] != ah[:-1]])
    new = new_anchor | np.concatenate([[True], sh[1:] != sh[:-1]])
    segment, anchor = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
    first = ord_[np.flatnonzero(new)]
    repeat = ord_ > first[segment]
    # an anchor with several segments, not all of one document
    of_segment = anchor[np.flatnonzero(new)]
    low = np.full(anchor[-1] + 1, LAST)
    high = np.full(anchor[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, of_segment, first)
    np.maximum.at(high, of_segment, first)
    several = (np.bincount(of_segment) > 1) & (low < high)
    several |= _is_hot(ah[np.flatnonzero(new_anchor)], hot)  # its other segments are in other buckets
    open_ = ~repeat & several[anchor]
    return pa.concat_tables([_to_docs(ord_[repeat], key[repeat], lo[repeat], cnt[repeat], parts),
                             _to_docs(ord_[open_], key[open_], lo[open_], cnt[open_], parts, ah[open_])])


_UNDECIDED = ("u8", "i8", "i4", "i4", "i4", "i4", "u1")


def _undecided(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """``(bucket, cell)``: undecided segments with their bytes.

    Equal windows have equal bytes on both sides of the anchor, so those of a
    hot anchor go by all of their bytes, a window at a time; of equal windows in
    one flush only the smallest id's go on, as for segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0

        def packed(ah, ords, keys, lo, cnt, size, data) -> Iterator[tuple[int, bytes]]:
            of = (ah % U64(buckets)).astype(np.int64)
            base = np.cumsum(size, dtype=np.int64) - size
            order = np.argsort(of, kind="stable")
            starts, bounds = groups(of[order])
            for a, b in zip(starts, bounds[1:], strict=True):
                i = order[a:b]
                yield int(of[i[0]]), pack(ah[i], ords[i], keys[i], lo[i], cnt[i], size[i], data[_ranges(base[i], size[i])])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, held_bytes
            ah, ords, keys, lo, cnt, size, data = (np.concatenate(x) for x in zip(*held, strict=True))
            held, held_bytes = [], 0
            base = np.cumsum(size, dtype=np.int64) - size
            often = _is_hot(ah, hot)
            for mine in (np.flatnonzero(~often), np.flatnonzero(often)):
                some = [x[mine] for x in (ah, ords, keys, lo, cnt, size)]
                some.append(data[_ranges(base[mine], size[mine])])
                if len(mine) and often[mine[0]]:
                    for piece, within, hit, windows, name in _windows(some[0], some[1], *some[4:]):
                        if hit.any():
                            i = piece[hit]
                            yield _cells([_known(some[1][i], some[2][i], some[3][i] + within[hit], np.ones(len(i), np.int32))])
                        i, one = piece[~hit], np.ones(int((~hit).sum()), np.int32)
                        yield _cells(list(packed(name[~hit], some[1][i], some[2][i], (some[3][i] + within[~hit]).astype(np.int32),
                                                 one, one * WINDOW, windows(~hit))))
                elif len(mine):
                    yield _cells(list(packed(*some)))

        for batch in batches:
            lists = batch.column("ah")
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            lo, cnt = (batch.column(c).flatten().to_numpy() for c in ("lo", "cnt"))
            ah = flat.astype(U64)
            ords, keys = batch.column("ord").to_numpy()[row], batch.column("key").to_numpy()[row]
            text = batch.column("text").cast(pa.large_string())
            base = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text)]
            data = np.frombuffer(text.buffers()[2], np.uint8)
            size = (cnt + WINDOW - 1).astype(np.int32)
            for part in np.array_split(np.arange(len(ah)), int(size.sum()) // FLUSH_BYTES + 1):
                held.append((ah[part], ords[part], keys[part], lo[part], cnt[part], size[part],
                             data[_ranges(base[row[part]] + lo[part], size[part])]))
                held_bytes += int(size[part].sum())
                if held_bytes >= FLUSH_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select("ord", "key", "text", "lo", "cnt", "ah").mapInArrow(run, "bucket long, cell binary")


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + size[0] - 1, begin[1] .. and so on."""
    return np.repeat(begin - (np.cumsum(size, dtype=np.int64) - size), size) + np.arange(int(size.sum()))


class SuffixSort:
    """Sorts suffixes of one buffer, cut to ``length`` bytes, group by group."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.hashes = data, length, PrefixHash(data)
        #: the 8 bytes at every place
        self.words = np.ndarray((len(data),), ">u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension up to ``length``: binary search over hashes."""
        good, bad = np.zeros(len(a), np.int64), np.full(len(a), self.length + 1)
        while True:
            going = bad - good > 1
            if not going.any():
                return good
            mid = (good + bad) >> 1
            same = self.hashes.raw(a, a + mid) == self.hashes.raw(b, b + mid)
            good = np.where(going & same, mid, good)
            bad = np.where(going & ~same, mid, bad)

    def word(self, at: np.ndarray, size: int) -> np.ndarray:
        """``size`` bytes, 8 at most, as one number that sorts as they do."""
        return self.words[at].astype(U64) >> U64(64 - 8 * size)

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes: by group (given sorted), then by 8 bytes at a time.

        Only suffixes that agree with another of their group so far are looked at
        again; all groups are refined in the same numpy passes.
        """
        order, place, same = np.arange(len(start)), np.arange(len(start)), group
        for depth in range(0, self.length, 8):
            starts, bounds = groups(same)
            several = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
            place, same = place[several], same[several]
            if not len(place):
                break
            word = self.word(start[order[place]] + depth, min(8, self.length - depth))
            by = np.lexsort((word, same))
            order[place] = order[place[by]]
            word = word[by]
            same = np.cumsum(np.append(False, (same[1:] != same[:-1]) | (word[1:] != word[:-1])))
        return order


def _windows(ah: np.ndarray, ord_: np.ndarray, cnt: np.ndarray, size: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
    """Suffix sort of all windows, some SORT_BYTES of whole anchors at a time.

    Yields the windows' segment and place in it, whether an equal window has a
    smaller id, a function that gives the bytes of some, and a hash of the bytes.
    """
    by = np.argsort(ah, kind="stable")
    base = np.cumsum(size, dtype=np.int64) - size
    upto = np.concatenate([[0], np.cumsum(size[by], dtype=np.int64)])
    ends = groups(ah[by])[1][1:]
    step = np.arange(WINDOW)
    a = 0
    while a < len(by):
        fit = int(np.searchsorted(upto[ends], upto[a] + SORT_BYTES, side="right")) - 1
        b = int(max(ends[max(fit, 0)], ends[np.searchsorted(ends, a, side="right")]))
        i, a = by[a:b], b
        part = data[_ranges(base[i], size[i])]
        begin = np.cumsum(size[i], dtype=np.int64) - size[i]
        start = _ranges(begin, cnt[i])
        piece = np.repeat(i, cnt[i])
        within = start - np.repeat(begin, cnt[i])
        sorter = SuffixSort(np.append(part, np.uint8(0)), WINDOW)
        order = sorter.sort(start, ah[piece])
        piece, within, start = piece[order], within[order], start[order]
        same = np.zeros(len(start), bool)
        x, y = start[:-1], start[1:]
        whole = sorter.hashes.raw(start, start + WINDOW)
        close = np.flatnonzero((whole[1:] == whole[:-1]) & (ah[piece[:-1]] == ah[piece[1:]]))
        for c in np.array_split(close, len(close) // 100_000 + 1):  # verified byte by byte
            same[c + 1] = (part[x[c][:, None] + step] == part[y[c][:, None] + step]).all(axis=1)
        number = np.cumsum(~same) - 1
        smallest = np.full(number[-1] + 1, LAST)
        np.minimum.at(smallest, number, ord_[piece])

        def windows(some: np.ndarray, part=part, start=start) -> np.ndarray:
            return part[(start[some][:, None] + step).ravel()]

        yield (piece, within, ord_[piece] > smallest[number], windows,
               mix(whole, 27) & _48)


def _judge_windows(bucket: pa.Table, parts: int) -> pa.Table:
    """Suffix sort of the undecided windows of one bucket: the repeats among them."""
    told = _told(bucket, parts)
    if told is not None:
        return told
    ah, ord_, key, lo, cnt, size, data = joined((c.as_buffer() for c in bucket.column("cell")), *_UNDECIDED)
    found = [(piece[hit], within[hit]) for piece, within, hit, _, _ in _windows(ah, ord_, cnt, size, data)]
    piece, within = (np.concatenate(x) for x in zip(*found, strict=True))
    return _to_docs(ord_[piece], key[piece], lo[piece] + within, np.ones(len(piece), np.int32), parts)


def _cleaned(docs: DataFrame) -> DataFrame:
    """``(ord, key, spans, kept)``: maximal removed runs and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, end = batch.column("begin"), batch.column("end")
            at = pa.array(np.append(0, np.cumsum(begin.value_lengths().to_numpy())).astype(np.int32))
            spans = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([begin.flatten(), end.flatten()], ["start", "end"]))
            kept = []
            for i in range(len(batch)):
                data = memoryview(batch.column("text")[i].as_buffer())
                stops = [*begin[i].values.to_pylist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip([0, *end[i].values.to_pylist()], stops, strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("key"), spans, pa.array(kept, pa.binary())],
                                             ["ord", "key", "spans", "kept"])

    return docs.select("ord", "key", "text", "begin", "end").mapInArrow(
        run, "ord long, key int, spans array<struct<start:int,end:int>>, kept binary")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(ord, key, spans, kept)`` of the documents that lose bytes."""
    rows = keyed(docs)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    hot = _hot(rows)

    def judge(bucket: pa.Table) -> pa.Table:
        return _judge_segments(bucket, buckets, hot)

    def judge_windows(bucket: pa.Table) -> pa.Table:
        return _judge_windows(bucket, buckets)

    # ``texts`` has one form in both joins, so that Spark shuffles it once
    texts = rows.select("ord", "key", "text")
    mine = (F.col("ord") == F.col("o")) & (F.col("key") == F.col("k"))
    verdicts = stored(_anchored(rows, buckets, hot).groupBy("bucket").applyInArrow(judge, _CELLS), "verdicts", free=True)
    undecided = verdicts.where("open").groupBy("part").applyInArrow(
        _open_by_doc, "o long, k int, lo array<int>, cnt array<int>, ah array<long>")
    late = _undecided(texts.join(undecided, mine), buckets, hot).groupBy("bucket").applyInArrow(judge_windows, _CELLS)
    runs = verdicts.where("not open").unionByName(late).groupBy("part").applyInArrow(
        _runs_by_doc, "o long, k int, begin array<int>, end array<int>")
    return _cleaned(texts.join(runs, mine))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept_sha256)`` of every row.

    ``spans`` are the maximal removed runs as byte offsets, end exclusive.
    """
    lost = (repeated_passages(docs).select(F.col("ord").alias("o"), F.col("key").alias("k"), "spans",
                                           F.sha2("kept", 256).alias("sha")).dropDuplicates(["o", "k"]))
    base = keyed(docs).select("doc_id", "ord", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                              F.sha2("text", 256).alias("whole"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (base.join(stored(lost, "removed"), (F.col("ord") == F.col("o")) & (F.col("key") == F.col("k")), "left")
            .select("doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"),
                    F.coalesce("sha", "whole").alias("kept_sha256")))


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return removed.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
