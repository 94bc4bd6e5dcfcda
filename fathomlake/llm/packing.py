"""Packing documents into sequences along a Hilbert curve.

A document's ids are counted in hashed buckets, the counts' shares are projected to three dimensions by
fixed signs, and the point becomes a Hilbert key. Documents are range-sorted by key (and doc_id, so that
copies, which share a key, can lie in many partitions), and each partition cuts its stream of ids every
``length`` ids. What is left at a partition's end fills sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, give_back, table_path, text_of, tidy
from .tokens import forget, piece_tokenizer, slices, tokenizer_path

LENGTH = 4096
END_ID = 2
BUCKETS = 64
DIMS = 3
DEPTH = 16
#: Sequences of a partition that can be numbered.
ROOM = 1 << 40


def bucket_of(ids: np.ndarray) -> np.ndarray:
    """Hash bucket of each id, by a multiplicative hash."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)


def signs() -> np.ndarray:
    """BUCKETS x DIMS fixed signs: parities of the bucket's number under masks."""
    k = np.arange(BUCKETS)[:, None] & np.array([0b010101, 0b110011, 0b101110])[None, :]
    return 1.0 - 2.0 * (np.bitwise_count(k) % 2)


def points_of(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of DIMS numbers below 2**DEPTH for each document; a document without ids lies in the middle."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(doc * BUCKETS + bucket_of(ids), minlength=len(sizes) * BUCKETS).reshape(len(sizes), BUCKETS)
    mean = counts @ signs() / np.maximum(sizes, 1)[:, None]
    return np.clip((1 / (1 + np.exp(-8 * mean))) * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)


def hilbert_key(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Place of each point on the Hilbert curve of that depth: axes are folded bit by bit, then Gray-decoded."""
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    bit = 1 << (depth - 1)
    while bit > 1:
        low = bit - 1
        for d in range(len(x)):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            if d:
                x[d] ^= swap
        bit >>= 1
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flip, bit = np.zeros(len(points), np.int64), 1 << (depth - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    key = np.zeros(len(points), np.int64)
    for b in range(depth - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> b) & 1)
    return key


class _Packer:
    """The stream of one partition: documents go in, pieces of finished sequences come out."""

    def __init__(self, length: int, first: int, with_ids: bool):
        self.length, self.sequence, self.with_ids = length, first, with_ids
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[tuple] = []  # (doc_id, all its ids, those before what is held, those held)

    def push(self, docs: list[tuple], ids: np.ndarray) -> list[tuple]:
        self.docs += docs
        self.ids = np.concatenate([self.ids, ids])
        full = len(self.ids) // self.length
        return self._cut(np.full(full, self.length, np.int64))

    def end(self) -> list[tuple]:
        left, sizes = len(self.ids), []
        while left:
            sizes.append(1 << (left.bit_length() - 1))
            left -= sizes[-1]
        return self._cut(np.asarray(sizes, np.int64))

    def _cut(self, sizes: np.ndarray) -> list[tuple]:
        if not len(sizes):
            return []
        held = np.asarray([d[3] for d in self.docs], np.int64)
        doc_from = np.cumsum(held) - held
        seq_to = np.cumsum(sizes)
        seq_from, end = seq_to - sizes, int(seq_to[-1])
        cuts = np.union1d(doc_from[doc_from < end], seq_from)
        ends = np.append(cuts[1:], end)
        doc = np.searchsorted(doc_from, cuts, "right") - 1
        seq = np.searchsorted(seq_from, cuts, "right") - 1
        raw, out = self.ids[:end].astype("<u4").tobytes(), []
        for a, b, d, s in zip(cuts.tolist(), ends.tolist(), doc.tolist(), seq.tolist()):
            name, whole, before, _ = self.docs[d]
            part = raw[4 * a : 4 * b]
            out.append((name, before + a - int(doc_from[d]), b - a, zlib.crc32(part), whole, self.sequence + s, a - int(seq_from[s]), part if self.with_ids else None))
        self.sequence += len(sizes)
        last = int(np.searchsorted(doc_from, end, "left"))  # documents from here on are untouched
        rest = self.docs[last:]
        if last and doc_from[last - 1] + held[last - 1] > end:
            name, whole, before, n = self.docs[last - 1]
            used = end - int(doc_from[last - 1])
            rest = [(name, whole, before + used, n - used), *rest]
        self.docs, self.ids = rest, self.ids[end:]
        return out


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_NAMES = [x.split(" ")[0] for x in PIECES.split(", ")]


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Every id of every document (its text's ids, then ``end_id``) lies in one piece. Null text is empty and gives
    ``end_id`` alone. Equal keys go by doc_id (null first); rows that repeat a doc_id are packed each, as neighbours in
    no fixed order if their texts differ. No rows give none; other columns are ignored.
    """
    spark, name = docs.sparkSession, tokenizer or tokenizer_path()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = piece_tokenizer(name)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):  # the ids of a few texts at a time, whatever a batch holds
                flat, sizes = tok.encode(texts.slice(a, b - a))
                keys = hilbert_key(points_of(flat, sizes))
                flat = np.insert(flat, np.cumsum(sizes), end_id).astype("<u4")
                ends = 4 * np.cumsum(sizes + 1)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.int64()), raw.cast(pa.binary())], names=["doc_id", "key", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()  # the worker may be one that tokenized
        give_back()
        packer = _Packer(length, TaskContext.get().partitionId() * ROOM, with_ids)

        def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(_NAMES, zip(*out))], names=_NAMES)

        for batch in batches:
            ids = batch.column(1)
            for at in range(0, len(ids), 1000):
                values = [np.frombuffer(x, "<u4") for x in ids.slice(at, 1000).to_pylist()]
                names = batch.column(0).slice(at, 1000).to_pylist()
                yield from rows(packer.push([(d, len(v), 0, len(v)) for d, v in zip(names, values)], np.concatenate(values)))
        yield from rows(packer.end())

    path = table_path(spark, "placed")
    docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(tidy(place), "doc_id bigint, key bigint, ids binary").write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema("doc_id bigint, key bigint, ids binary").parquet(path)
    ordered = placed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")
    return ordered.mapInArrow(tidy(cut), PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False).drop("ids")
