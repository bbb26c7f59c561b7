"""Alignment of two tokenizers' tokens over the same bytes.

A document is tokenised whole by A (byte-level BPE) and B (pieces with byte
fallback), both over a space and the text.  Byte offsets where tokens of both
end cut the streams into groups; tokens of one group are linked.

Anchors make this cheap: a shared end with a space-marked token after it in both
streams cuts the document into windows of token ids, most of them one word.
Shared ends are verified on the byte lengths of the tokens, and the joined bytes
of both streams are compared with the text.  Equal windows are aligned once: a
task memoises groups, links and their text form by the tuple of A's and B's ids.

A word's windows are found when the word is new: its tokens of A and B end where
the word ends and the next word begins with a space in both, so a word's end is
an anchor of the document.

Neither tokenizer joins anything over a single space between two other
characters (A by its pre-tokenizer's pattern, B as no piece has a space mark
after another character, which is checked when it is loaded).  So runs between
such spaces are tokenised once per task as well, and a text of any length is
worked on in pieces.  Memos are bounded: rare words go when they pass a fixed size.

Counts of linked id pairs (in how many documents a pair is linked) are made in
two steps.  A task packs blocks of documents, each with its distinct pairs;
blocks send their distinct pairs with a document count, the sums go back to the
blocks that hold the pair, and each block finishes its documents.  What is
shuffled is a block's distinct pairs, not a document's links.

Defined results: texts that are null or empty, or whose joined tokens are not
the text's bytes (for B, a text with U+2581) have no tokens; every row is a
document, also with a null or repeated id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack, unpack
from .tables import documents, stored

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: fixed value: SentencePiece's mark of a space
MARK = "▁"
#: a pair of ids is one number: A's id times this, plus B's id
PAIR = 1 << 20
#: characters of text in a block, in a run of documents, split at once; new words aligned at once
BLOCK, RUN, PIECE, SLICE = 8 << 20, 1 << 19, 1 << 20, 1 << 16
#: words, windows and their bytes a task remembers
MEMO, MEMO_BYTES = 200_000, 32 << 20

#: parts A's ids from B's in a window's key
NO_ID = np.array([-1], np.int32).tobytes()

SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes a byte as a character: printable Latin-1 ones as
    themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + n[i] - 1 of all i."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Ragged:
    """Growing list of integer runs in one array."""

    def __init__(self, dtype: type = np.int32) -> None:
        self.data, self.used = np.empty(1 << 12, dtype), 0
        self.start, self.n = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64)
        self.rows = 0

    def extend(self, flat: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(flat) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        while self.rows + len(n) > len(self.n):
            self.start, self.n = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.n))
        self.data[self.used: self.used + len(flat)] = flat
        own = slice(self.rows, self.rows + len(n))
        self.n[own], self.start[own] = n, self.used + np.cumsum(n) - n
        self.used += len(flat)
        self.rows += len(n)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the given rows one after another (as long), and each row's number of them."""
        n = self.n[rows]
        return self.data[_spread(self.start[rows], n)].astype(np.int64, copy=False), n

    def kept(self, rows: np.ndarray) -> Ragged:
        out = Ragged(self.data.dtype.type)
        out.extend(*self.take(rows))
        return out


def _flat(runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, runs), np.int64, len(runs))
    return np.fromiter(chain.from_iterable(runs), np.int64, int(n.sum())), n


class Numbered(dict):
    """Words by number, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Windows:
    """Memoised windows: alignments by id tuples (A's ids, ``NO_ID``, B's ids)."""

    of: dict = field(default_factory=dict)
    text: list = field(default_factory=list)
    groups: Ragged = field(default_factory=Ragged)
    pairs: Ragged = field(default_factory=lambda: Ragged(np.int64))
    times: Ragged = field(default_factory=Ragged)

    def kept(self, rows: np.ndarray) -> Windows:
        keys = list(self.of)
        return Windows({keys[r]: i for i, r in enumerate(rows.tolist())}, [self.text[r] for r in rows.tolist()],
                       self.groups.kept(rows), self.pairs.kept(rows), self.times.kept(rows))


class Aligner:
    """Both tokenizers and the memos of one task."""

    def __init__(self, spec_a: str, model_b: bytes):
        # Spark runs the tasks in parallel
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        alphabet = byte_alphabet()
        spec = json.loads(spec_a)
        names = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        plain = {t["id"] for t in spec["added_tokens"]}
        self.bytes_a = [names[i].encode() if i in plain else bytes(alphabet[c] for c in names[i]) if i in names else b""
                        for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.marked = [f"{mark}{i}" for mark, n in ((";", self.n_a), (",", self.n_a), (",", self.n_b), ("|", self.n_b))
                       for i in range(n)]
        #: whether texts can be tokenised in runs between single spaces
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces) and spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.table_a, self.table_b = (np.frombuffer(b"".join(t), np.uint8) for t in (self.bytes_a, self.bytes_b))
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.start_a, self.start_b = (np.cumsum(x) - x for x in (self.length_a, self.length_b))
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.words, self.words_size, self.seen = Numbered(), 0, np.zeros(0, np.int64)
        self.ids_a, self.ids_b, self.fits = Ragged(), Ragged(), np.zeros(0, bool)
        self.windows, self.in_word = Windows(), Ragged()

    def trim(self, most: int | None = None, size: int | None = None) -> None:
        """Forget rare words when there are too many, so that half of them go at least."""
        most, size = most or MEMO, size or MEMO_BYTES
        if len(self.words) <= most and self.words_size <= size:
            return
        words = list(self.words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        often = 1
        keep = np.arange(len(words))
        while len(keep) > most // 2 or length[keep].sum() > size // 8:
            often *= 2
            keep = np.flatnonzero(self.seen >= often)
        self.words = Numbered({words[r]: i for i, r in enumerate(keep.tolist())})
        self.words_size, self.seen, self.fits = int(length[keep].sum()) * 2, self.seen[keep], self.fits[keep]
        self.ids_a, self.ids_b = self.ids_a.kept(keep), self.ids_b.kept(keep)
        row, n = self.in_word.take(keep)
        used, row = np.unique(row, return_inverse=True)
        self.windows, self.in_word = self.windows.kept(used), Ragged()
        self.in_word.extend(row, n)

    def _tokenise(self, words: list[str]) -> None:
        """Token ids of new words, each with a space before it."""
        spaced = [" " + w for w in words]
        a, n_a = _flat([e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)])
        b, n_b = _flat(self.b.encode(words, num_threads=1))
        self.ids_a.extend(a, n_a)
        self.ids_b.extend(b, n_b)
        raw = [w.encode() for w in spaced]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        want = np.frombuffer(b"".join(raw), np.uint8)
        fits = [self._fits(*x, want, size) for x in ((self.table_a, self.start_a, self.length_a, a, n_a),
                                                     (self.table_b, self.start_b, self.length_b, b, n_b))]
        self.fits = np.concatenate([self.fits, fits[0] & fits[1]])
        self.words_size += int(size.sum())

    @staticmethod
    def _fits(table: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, n: np.ndarray,
              want: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Are the joined bytes of each word's tokens the word's own?"""
        word = np.repeat(np.arange(len(n)), n)
        have = np.bincount(word, length[ids], len(n)).astype(np.int64)
        fits = have == size
        ids, n = ids[fits[word]], n[fits]
        got = table[_spread(start[ids], length[ids])]
        own = want if fits.all() else want[np.repeat(fits, size)]
        wrong = np.flatnonzero(got != own)
        if len(wrong):
            fits[np.flatnonzero(fits)[np.searchsorted(np.cumsum(size[fits]), wrong, side="right")]] = False
        return fits

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The text at its single spaces, some ``PIECE`` characters at a time."""
        at = 0
        while at < len(text):
            cut = SINGLE_SPACE.search(text, at + PIECE) if self.cuts and len(text) - at > PIECE else None
            piece = text[at: cut.start() if cut else len(text)]
            yield SINGLE_SPACE.split(piece) if self.cuts else [piece]
            at = cut.end() if cut else len(text)

    def words_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Memo rows of each text's words; new words are tokenised and aligned together."""
        known, number, out = len(self.words), self.words.__getitem__, []
        for text in texts:
            own = [np.fromiter(map(number, words), np.int64, len(words)) for words in self._runs(text or "")]
            out.append(np.concatenate(own) if own else np.zeros(0, np.int64))
        new = list(islice(self.words, known, None))
        if new:
            self._tokenise(new)
        for at in range(known, len(self.words), SLICE):
            self._windows_in(np.arange(at, min(at + SLICE, len(self.words))))
        self.seen = np.append(self.seen, np.zeros(len(new), np.int64)) + np.bincount(np.concatenate(out), minlength=len(self.words))
        return out

    def _windows_in(self, words: np.ndarray) -> None:
        """Windows of new words; those that do not fit have none."""
        fits = self.fits[words]
        n = np.zeros(len(words), np.int64)
        row = np.zeros(0, np.int64)
        if fits.any():
            row, start, n_a = self.windows_of(words[fits])
            n[fits] = np.bincount(np.repeat(np.arange(len(n_a)), n_a)[start], minlength=len(n_a))
        self.in_word.extend(row, n)

    def windows_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of words side by side: memo row, place of the first A token, A tokens a word."""
        a, n_a = self.ids_a.take(words)
        b, _ = self.ids_b.take(words)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.zeros(end_a[-1] + 1, np.int8)
        ends[end_a] += 1
        ends[end_b] += 2
        shared_a, shared_b = ends[end_a] == 3, ends[end_b] == 3
        stop_a = np.flatnonzero(shared_a & np.append(self.space_a[a[1:]], True)) + 1
        stop_b = np.flatnonzero(shared_b & np.append(self.space_b[b[1:]], True)) + 1
        start_a, start_b = (np.concatenate([[0], x[:-1]]) for x in (stop_a, stop_b))
        of, row, new = self.windows.of, [], []
        raw_a, raw_b = a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes()
        for i, (p, q, x, y) in enumerate(zip(*((4 * v).tolist() for v in (start_a, stop_a, start_b, stop_b)), strict=True)):
            key = raw_a[p:q] + NO_ID + raw_b[x:y]
            known = of.get(key)
            if known is None:
                known = of[key] = len(of)
                new.append(i)
            row.append(known)
        if new:
            self._align(a, b, shared_a, shared_b, *(v[new] for v in (start_a, stop_a, start_b, stop_b)))
        return np.array(row, np.int64), start_a, n_a

    def _align(self, a: np.ndarray, b: np.ndarray, shared_a: np.ndarray, shared_b: np.ndarray, start_a: np.ndarray,
               stop_a: np.ndarray, start_b: np.ndarray, stop_b: np.ndarray) -> None:
        """Memo rows of new windows, in order: groups, links and text."""
        n_a, n_b = stop_a - start_a, stop_b - start_b
        at_a, at_b = _spread(start_a, n_a), _spread(start_b, n_b)
        a, b, shared_a, shared_b = a[at_a], b[at_b], shared_a[at_a], shared_b[at_b]
        last_a, last_b = np.flatnonzero(shared_a), np.flatnonzero(shared_b)  # a window ends a group, so groups pair up
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        from_a, from_b = last_a + 1 - in_a, last_b + 1 - in_b
        window = np.searchsorted(np.cumsum(n_a), last_a, side="right")
        rows = len(n_a)
        groups = np.bincount(window, minlength=rows)
        self.windows.groups.extend(np.stack([groups, np.bincount(window, in_a * in_b, rows).astype(np.int64)], 1).ravel(),
                                   np.full(rows, 2))

        # text: A's ids, then B's, group by group; an id carries the mark before it
        place = np.cumsum(in_a + in_b) - in_a - in_b
        parts = np.empty(len(a) + len(b), np.int64)
        parts[_spread(place, in_a)] = a + self.n_a
        parts[place] = a[from_a]
        parts[_spread(place + in_a, in_b)] = b + 2 * self.n_a
        parts[place + in_a] = b[from_b] + 2 * self.n_a + self.n_b
        marked = list(map(self.marked.__getitem__, parts.tolist()))
        stop = np.cumsum(n_a + n_b)
        self.windows.text += ["".join(marked[x:y])[1:] for x, y in zip((stop - n_a - n_b).tolist(), stop.tolist(), strict=True)]

        # links: large groups by their distinct ids, the others one by one
        large = in_a * in_b > 4096
        size = np.where(large, 0, in_a * in_b)
        group = np.repeat(np.arange(len(size)), size)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        code = a[from_a[group] + step // in_b[group]] * PAIR + b[from_b[group] + step % in_b[group]]
        of, times = window[group], np.ones(len(code), np.int64)
        for g in np.flatnonzero(large):
            x, n = np.unique(a[from_a[g]: last_a[g] + 1], return_counts=True)
            y, m = np.unique(b[from_b[g]: last_b[g] + 1], return_counts=True)
            code = np.append(code, np.add.outer(x * PAIR, y).ravel())
            times = np.append(times, np.outer(n, m).ravel())
            of = np.append(of, np.full(len(x) * len(y), window[g]))
        order = np.lexsort((code, of))
        code, of, times = code[order], of[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])]))
        each = np.bincount(of[new], minlength=rows)
        self.windows.pairs.extend(code[new], each)
        self.windows.times.extend(np.add.reduceat(times, new), each)


@dataclass
class Aligned:
    """One document: word and window rows of the memos."""

    words: np.ndarray
    windows: np.ndarray


def aligned_run(aligner: Aligner, texts: list[str | None]) -> list[Aligned | None]:
    """Alignments of some texts; None for those without tokens."""
    words = [own if len(own) and aligner.fits[own].all() else None for own in aligner.words_of(texts)]
    return [None if w is None else Aligned(w, aligner.in_word.take(w)[0]) for w in words]


def _runs_of(batches: Iterator[pa.RecordBatch], size: int = RUN) -> Iterator[tuple[list, list]]:
    """Ids and texts of the rows, some MB of texts at a time."""
    for batch in batches:
        ids, texts, have, at = batch.column("doc_id").to_pylist(), [], 0, 0
        for i, text in enumerate(batch.column("text")):
            texts.append(text.as_py())
            have += len(texts[-1] or "")
            if have >= size:
                yield ids[at: i + 1], texts
                texts, have, at = [], 0, i + 1
        if texts:
            yield ids[at:], texts


def _specs(spark, folder: str, name_a: str, name_b: str):
    """Both vocabulary files' contents as a broadcast (a few MB, whatever the data)."""
    with open(f"{folder}/{name_a}", encoding="utf-8") as a, open(f"{folder}/{name_b}", "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def align(docs: DataFrame, folder: str = TOKENIZERS, name_a: str = BYTE_BPE, name_b: str = PIECE_BPE) -> DataFrame:
    """``(doc_id, a_ids, b_ids, a_in_group, b_in_group)``: both streams and each group's number of tokens."""
    specs = _specs(docs.sparkSession, folder, name_a, name_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*specs.value)
        for ids, texts in _runs_of(batches):
            aligner.trim()
            out: dict[str, list] = {"a_ids": [], "b_ids": [], "a_in_group": [], "b_in_group": []}
            for x in aligned_run(aligner, texts):
                rows = np.zeros(0, np.int64) if x is None else x.words
                groups = [] if x is None else [g.split("|") for w in x.windows.tolist() for g in aligner.windows.text[w].split(";")]
                out["a_ids"].append(aligner.ids_a.take(rows)[0])
                out["b_ids"].append(aligner.ids_b.take(rows)[0])
                out["a_in_group"].append([g[0].count(",") + 1 for g in groups])
                out["b_in_group"].append([g[1].count(",") + 1 for g in groups])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64())} | {
                k: pa.array(v, pa.list_(pa.int32())) for k, v in out.items()})

    return documents(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, "
                                           "a_in_group array<int>, b_in_group array<int>")


FACTS = "n_a", "n_b", "n_groups", "n_links"
BLOCKS = ("block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in FACTS)
          + ", groups_sha256 array<string>, n_pairs array<long>, pairs binary")


class Block:
    """Documents of a task until they are some ``BLOCK`` bytes of text."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {c: [] for c in ("doc_id", *FACTS, "groups_sha256", "n_pairs")}
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, aligner: Aligner, ids: list, texts: list[str | None]) -> None:
        w = aligner.windows
        for i, text, x in zip(ids, texts, aligned_run(aligner, texts), strict=True):
            sha, codes, times, facts = "", np.zeros(0, np.int64), np.zeros(0, np.int64), (0, 0, 0, 0)
            if x is not None:
                state = hashlib.sha256()
                rows = x.windows.tolist()
                for at in range(0, len(rows), 1 << 16):
                    state.update((";" * (at > 0) + ";".join(map(w.text.__getitem__, rows[at: at + (1 << 16)]))).encode())
                sha = state.hexdigest()
                row, n = np.unique(x.windows, return_counts=True)
                flat, each = w.pairs.take(row)
                often = w.times.take(row)[0] * np.repeat(n, each)
                codes, back = np.unique(flat, return_inverse=True)
                times = np.bincount(back, often, len(codes)).astype(np.int64)
                groups, links = (w.groups.take(row)[0].reshape(-1, 2) * n[:, None]).sum(0)
                facts = (int(aligner.ids_a.n[x.words].sum()), int(aligner.ids_b.n[x.words].sum()), int(groups), int(links))
            for c, v in zip(self.rows, (i, *facts, sha, len(codes)), strict=True):
                self.rows[c].append(v)
            self.codes.append(codes)
            self.times.append(times.astype(np.int32) if len(times) and times.max() < 1 << 31 else times)
            self.size += len(text or "")

    def packed(self, block: int) -> pa.RecordBatch:
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int64)
        names, place = np.unique(codes, return_inverse=True)
        n = np.bincount(place, minlength=len(names))
        times = np.concatenate(self.times).astype(np.int64) if self.times else np.zeros(0, np.int64)
        cell = pack(np.diff(names, prepend=0), n, place.astype(np.int32), times)
        out = {"block": pa.array([block], pa.int64())}
        for c, v in self.rows.items():
            out[c] = pa.array([v], pa.list_(pa.string() if c == "groups_sha256" else pa.int64()))
        return pa.RecordBatch.from_pydict(out | {"pairs": pa.array([cell], pa.binary())})


def _unpacked(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a block, documents with each, place of each document's pairs, their links."""
    steps, n, place, times = unpack(cell, "i8", "i8", "i4", "i8")
    return np.cumsum(steps), n, place, times


def blocks(docs: DataFrame, folder: str = TOKENIZERS, name_a: str = BYTE_BPE, name_b: str = PIECE_BPE) -> DataFrame:
    """Aligned documents packed by block, stored."""
    specs = _specs(docs.sparkSession, folder, name_a, name_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, done = Aligner(*specs.value), Block(), 0
        first = TaskContext.get().partitionId() << 32
        for ids, texts in _runs_of(batches):
            aligner.trim()
            block.add(aligner, ids, texts)
            if block.size >= BLOCK:
                yield block.packed(first + done)
                block, done = Block(), done + 1
        if block.rows["doc_id"]:
            yield block.packed(first + done)

    return stored(documents(docs).mapInArrow(run, BLOCKS), "aligned")


def pair_counts(packed: DataFrame) -> DataFrame:
    """``(pair, n, best)``: documents that hold a linked id pair, and whether its A id has none in more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("pairs"):
                names, n, _, _ = _unpacked(cell.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["pair", "n"])

    counts = stored(packed.select("pairs").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")),
                    "pair-counts")
    most = counts.groupBy(F.expr(f"pair div {PAIR}").alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.expr(f"pair div {PAIR}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(packed: DataFrame) -> DataFrame:
    """One row a document: its facts, ``n_best`` and ``count_sum`` over its links."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cell in zip(batch.column("block").to_pylist(), batch.column("pairs"), strict=True):
                names = _unpacked(cell.as_py())[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), pa.array(names)], ["block", "of"])

    known = (packed.select("block", "pairs").mapInArrow(wanted, "block long, of long")
             .join(pair_counts(packed), F.col("of") == F.col("pair")).select("block", "pair", "n", "best"))

    def finish(block: pa.Table, counts: pa.Table) -> pa.Table:
        parts = [_finished(row, counts) for row in block.to_pylist()]
        return pa.concat_tables(parts)

    def _finished(row: dict, counts: pa.Table) -> pa.Table:
        names, _, place, times = _unpacked(row["pairs"])
        pair = counts.column("pair").to_numpy()
        order = np.searchsorted(names, pair)
        n, best = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        n[order], best[order] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        doc = np.repeat(np.arange(len(row["n_pairs"])), row["n_pairs"])
        size = len(row["n_pairs"])
        sums = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(sums[0], doc, times * best[place])
        np.add.at(sums[1], doc, times * n[place])
        return pa.table({"doc_id": pa.array(row["doc_id"], pa.int64())} | {c: pa.array(row[c], pa.int64()) for c in FACTS}
                        | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": pa.array(row["groups_sha256"], pa.string())})

    return packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        finish, "doc_id long, " + ", ".join(f"{c} long" for c in FACTS) + ", n_best long, count_sum long, groups_sha256 string")


def digest(docs: DataFrame, folder: str = TOKENIZERS, name_a: str = BYTE_BPE, name_b: str = PIECE_BPE) -> DataFrame:
    return link_counts(blocks(docs, folder, name_a, name_b))
