"""Token-ID output in training order: permuted, fixed-stride binary shards.

Documents become sequences of at most ``length`` token ids.  A sequence has a
dense index, its place in the order of files and rows; a keyed Feistel
permutation with cycle-walking maps the index to a global slot, without a table
and without a sort.  Slots are cut into shards of equally many records, and a
record has a fixed width, so slot s is at byte ``(s % per_shard) * stride`` of
shard ``s // per_shard``: a reader goes through a shard sequentially and
resumes at any slot.

A record: document id, number of the sequence in its document, number of
tokens (little-endian int64, int32, int32), the ids (``width`` bytes each, zero
behind the last), and one byte 0x0A.  Spark's own text writer writes the files,
through the file system and commit protocol of the output path.

Token ids: the default vocabulary is UTF-8 bytes, with 0xFF, which UTF-8 never
uses, as the end mark.  With ``vocabulary`` (a tiktoken rank file) ids are those of
that byte-level BPE in two bytes, and the first free id is the end mark.

The index needs the sequence count of each scan split; a first pass counts,
and the second is checked against it.  Shards are filled from packed cells, one
per batch and shard, so the shuffle moves compressed ids.

Defined results: a null or empty text is one sequence with the end mark alone; a
null id is written as -1 with its number of tokens negated minus one; repeated
rows are sequences of their own; no rows make no shard.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import groups, pack, unpack
from .scans import repeatable
from .tables import scratch, stored
from .textbatch import U64, mix, slices

LENGTH = 1024
SHARD_BYTES = 16 << 20
KEY = 0x5EED
ROUNDS = 6
HEADER = np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4")])
#: byte-level BPE: the split into pieces that such vocabularies are made with
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Feistel:
    """A keyed permutation of range(n): a balanced Feistel network over the
    next even power of two, walked until the value is below n."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n, self.key, self.rounds = n, key, rounds
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)

    def _round(self, right: np.ndarray, i: int) -> np.ndarray:
        return mix(right ^ mix(np.full(1, self.key & 0xFFFFFFFFFFFFFFFF, U64), 40 + i), 60 + i) & self._low

    @property
    def _low(self) -> np.uint64:
        return U64((1 << self.half) - 1)

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = x.astype(U64)
        out = step(x)
        while (far := np.flatnonzero(out >= U64(self.n))).size:
            out[far] = step(out[far])
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        def step(x: np.ndarray) -> np.ndarray:
            left, right = x >> U64(self.half), x & self._low
            for i in range(self.rounds):
                left, right = right, left ^ self._round(right, i)
            return (left << U64(self.half)) | right

        return self._walk(index, step)

    def index(self, slot: np.ndarray) -> np.ndarray:
        def step(x: np.ndarray) -> np.ndarray:
            left, right = x >> U64(self.half), x & self._low
            for i in reversed(range(self.rounds)):
                left, right = right ^ self._round(left, i), left
            return (left << U64(self.half)) | right

        return self._walk(slot, step)


@dataclass(frozen=True)
class Layout:
    """Where a slot is."""

    path: str
    n: int
    length: int
    width: int
    per_shard: int
    key: int

    @property
    def stride(self) -> int:
        return HEADER.itemsize + self.length * self.width + 1

    def place(self, slot: int) -> tuple[int, int]:
        """Shard and byte offset."""
        return slot // self.per_shard, slot % self.per_shard * self.stride


def _encoded(docs: DataFrame, vocabulary: str | None) -> DataFrame:
    """``(doc_id, ids)``: token ids as bytes, the end mark last."""
    if vocabulary is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("ids"))
    lines = "".join(r["value"] + "\n" for r in docs.sparkSession.read.text(vocabulary).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        bpe = tiktoken.Encoding("bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        end = np.array([max(ranks.values()) + 1], "<u2").tobytes()
        for batch in batches:
            ids = [np.array(bpe.encode_ordinary(t or ""), "<u2").tobytes() + end
                   for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids binary"), "token-ids")


def materialise(docs: DataFrame, path: str, length: int = LENGTH, key: int = KEY,
                shard_bytes: int = SHARD_BYTES, vocabulary: str | None = None) -> Layout:
    """Write the shards of ``docs`` under ``path`` as ``shard=<n>/part-*.txt``."""
    docs = repeatable(docs)
    width = 1 if vocabulary is None else 2
    end = b"\xff" if vocabulary is None else b""  # BPE ids come with their end mark
    rows = _encoded(docs, vocabulary)
    # a split of the scan is known by its task; files and rows give the order
    n_seq = F.ceil((F.coalesce(F.octet_length("ids"), F.lit(0)) + len(end)) / F.lit(length * width)).cast("long")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    splits = (rows.select(*place, n_seq.alias("n"), F.spark_partition_id().alias("task"))
              .groupBy("file", "task").agg(F.min("row").alias("row"), F.sum("n").alias("n")).collect())
    # one short row a scan split: the scheduler holds more than that for each of them
    start, n = {}, 0
    for r in sorted(splits, key=lambda r: (r["file"].rsplit("/", 1)[-1], r["file"], r["row"])):
        start[r["file"], r["task"]] = (r["row"], n, n + r["n"])
        n += r["n"]
    layout = Layout(path, n, length, width, max(1, shard_bytes // (HEADER.itemsize + length * width + 1)), key)
    if not n:
        return layout
    order = Feistel(n, key)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            files = batch.column("file").to_pylist()
            ids_of = batch.column("doc_id")
            known = np.asarray(ids_of.is_valid())
            ids_of = ids_of.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            for texts in slices(batch.column("ids"), 16 << 20):
                size = (np.diff(texts.offsets) + len(end))
                many = -(-size // (length * width))
                index = np.empty(texts.n, np.int64)
                for i in range(texts.n):
                    file = files[texts.first + i]
                    if file not in at:
                        row, at[file], _ = start[file, task]
                        if row != batch.column("row")[texts.first + i].as_py():
                            raise RuntimeError("a scan dealt other rows than the scan before it")
                    index[i] = at[file]
                    at[file] += many[i]
                doc = np.repeat(np.arange(texts.n), many)
                seq = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                slot = order.slot(index[doc] + seq)
                # ids with their end marks, document after document
                buffer = texts.data
                if end:
                    buffer = np.insert(texts.data, texts.offsets[1:], end[0])
                begin = (texts.offsets[:-1] + np.arange(texts.n) * len(end))[doc] + seq * length * width
                tokens = np.minimum(size[doc] - seq * length * width, length * width)
                shard = slot // layout.per_shard
                by = np.argsort(shard, kind="stable")
                starts, bounds = groups(shard[by])
                cells = []
                for a, b in zip(starts, bounds[1:], strict=True):
                    i = by[a:b]
                    take = np.repeat(begin[i], tokens[i]) + np.arange(tokens[i].sum()) - np.repeat(
                        np.cumsum(tokens[i]) - tokens[i], tokens[i])
                    row = doc[i] + texts.first
                    cells.append(pack(slot[i], ids_of[row], known[row].astype(np.uint8), seq[i].astype(np.int32),
                                      tokens[i].astype(np.int32), buffer[take]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[by[starts]]), pa.array(cells, pa.binary())], ["shard", "cell"])

    stride, body = layout.stride, length * width

    def records(table: pa.Table) -> pa.Table:
        parts = [unpack(c, "i8", "i8", "u1", "i4", "i4", "u1") for c in table.column("cell").to_pylist()]
        shard = table.column("shard")[0].as_py()
        first = shard * layout.per_shard
        count = min(layout.per_shard, n - first)
        out = np.zeros((count, stride - 1), np.uint8)
        for slot, ids, known, seq, tokens, data in parts:
            at = slot - first
            head = np.empty(len(at), HEADER)
            head["doc_id"], head["seq_no"] = ids, seq
            head["n_tokens"] = np.where(known == 1, tokens // width, -1 - tokens // width)
            out[at, :HEADER.itemsize] = head.view(np.uint8).reshape(len(at), -1)
            column = HEADER.itemsize + np.arange(tokens.sum()) - np.repeat(np.cumsum(tokens) - tokens, tokens)
            out[np.repeat(at, tokens), column] = data
        if sum(len(p[0]) for p in parts) != count:
            raise RuntimeError(f"shard {shard} got {sum(len(p[0]) for p in parts)} of {count} records")
        flat = pa.py_buffer(out)
        offsets = pa.py_buffer((np.arange(count + 1) * (stride - 1)).astype(np.int32))
        return pa.table({"shard": pa.array(np.full(count, shard)), "slot": pa.array(np.arange(first, first + count)),
                         "record": pa.Array.from_buffers(pa.binary(), count, [None, offsets, flat])})

    dealt = rows.select(*place, "doc_id", "ids").mapInArrow(deal, "shard long, cell binary")
    shards = (dealt.groupBy("shard").applyInArrow(records, "shard long, slot long, record binary")
              .sortWithinPartitions("shard", "slot"))
    # the text writer copies the bytes of a value and ends each with 0x0A
    (shards.select("shard", F.col("record").cast("string").alias("value"))
     .write.partitionBy("shard").option("compression", "none").text(path))
    return layout


def read_shards(spark: SparkSession, layout: Layout) -> DataFrame:
    """``(slot, shard, byte_offset, doc_id, seq_no, n_tokens, ids)``, read back
    from the files; a whole shard is one bounded read."""
    schema = ("slot long, shard long, byte_offset long, doc_id long, seq_no int, n_tokens int, ids binary")
    if not layout.n:
        return spark.createDataFrame([], schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, layout.stride)
                if not (raw[:, -1] == 0x0A).all():
                    raise RuntimeError(f"shard {shard} is damaged")
                head = np.ascontiguousarray(raw[:, :HEADER.itemsize]).view(HEADER).ravel()
                null = head["n_tokens"] < 0
                tokens = np.where(null, -1 - head["n_tokens"], head["n_tokens"])
                at = np.arange(len(raw))
                ids = [r[HEADER.itemsize: HEADER.itemsize + k * layout.width].tobytes() for r, k in zip(raw, tokens, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * layout.per_shard + at), pa.array(np.full(len(at), shard)), pa.array(at * layout.stride),
                     pa.array(head["doc_id"], mask=null), pa.array(head["seq_no"]), pa.array(tokens.astype(np.int32)),
                     pa.array(ids, pa.binary())],
                    ["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").load(layout.path)
    return files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(parse, schema)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """Write the shards of ``docs`` to a fresh shared folder and read them back."""
    spark = docs.sparkSession
    return read_shards(spark, materialise(docs, scratch(spark, "shards"), **options))


def digest(sequences: DataFrame) -> DataFrame:
    """One row a sequence: its place and a checksum of its ids."""
    return sequences.select("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens",
                            F.crc32("ids").alias("ids_crc32"))
