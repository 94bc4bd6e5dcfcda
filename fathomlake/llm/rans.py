"""Token ids in files of independent interleaved rANS blocks.

A file row is a segment: whole documents, about a million ids, with one static frequency table that its
blocks share. A block is a run of ids on LANES interleaved 32-bit states that give out 16-bit words. The
segment's index is a checkpoint for each block: where its words begin, the states that decoding starts
from, and the CRC-32 of its ids. So any block decodes alone, and numpy decodes all blocks side by side.
Spark's Parquet writer is the container, hence commits, lost executors and remote stores are its matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, table_path, text_of
from .tokens import piece_tokenizer, tokenizer_path

END_ID = 1
LANES = 32
BLOCK_IDS = 16_384
SEGMENT_IDS = 1 << 20
BITS = 16
LOW = np.uint64(1 << BITS)


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, and frequencies of at least 1 that sum to 2**16."""
    symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << BITS:
        raise ValueError(f"{len(symbols)} different ids in a segment; the table holds {1 << BITS}")
    freq = np.maximum(1, counts * (1 << BITS) // counts.sum()).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    gap = (1 << BITS) - int(freq.sum())
    if gap > 0:
        freq[order[0]] += gap
    at = 0
    while gap < 0:  # what the least frequent were given is taken from the most frequent
        take = min(-gap, max(0, int(freq[order[at]]) // 2))
        freq[order[at]] -= take
        gap += take
        at = (at + 1) % len(order)
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def encode_segment(ids: np.ndarray) -> dict:
    """Columns of a file row for the ids (at least one)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    symbols, freq = table_of(ids)
    blocks = -(-len(ids) // BLOCK_IDS)
    steps = -(-len(ids) // (blocks * LANES))
    which = np.searchsorted(symbols, ids)
    padded = np.full(blocks * steps * LANES, int(np.argmax(freq)), np.int64)
    padded[: len(ids)] = which
    grid = padded.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES)
    f, c = freq.astype(np.uint64), (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint64)
    state = np.full(blocks * LANES, LOW, np.uint64)
    words = np.empty((steps, blocks * LANES), np.uint16)
    out = np.empty((steps, blocks * LANES), bool)
    for t in range(steps - 1, -1, -1):
        own = f[grid[t]]
        out[t] = full = state >= (own << np.uint64(BITS))
        words[t] = state & np.uint64(0xFFFF)
        state = np.where(full, state >> np.uint64(BITS), state)
        q = state // own
        state = (q << np.uint64(BITS)) + (state - q * own) + c[grid[t]]
    words, out = (x.reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(blocks, -1) for x in (words, out))
    sizes = out.sum(1)
    size = steps * LANES
    crc = [zlib.crc32(ids[b * size : (b + 1) * size].astype("<u4").tobytes()) for b in range(blocks)]
    return {
        "n_ids": len(ids), "steps": steps, "symbols": symbols.astype("<u4").tobytes(), "frequencies": (freq - 1).astype("<u2").tobytes(),
        "block_words": np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes(), "block_states": state.astype("<u4").tobytes(),
        "block_crc32": np.asarray(crc, "<u4").tobytes(), "words": words[out].astype("<u2").tobytes(),
    }


def decode_segment(row: dict, blocks: list[int] | None = None) -> np.ndarray:
    """The segment's ids, or those of the named blocks one after another. Raises where a checksum differs."""
    symbols, freq = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["frequencies"], "<u2").astype(np.uint64) + np.uint64(1)
    bounds, states = np.frombuffer(row["block_words"], "<i8"), np.frombuffer(row["block_states"], "<u4").reshape(-1, LANES)
    words = np.concatenate([np.frombuffer(row["words"], "<u2"), np.zeros(1, np.uint16)])
    pick = np.arange(len(states)) if blocks is None else np.asarray(blocks)
    steps, n = row["steps"], row["n_ids"]
    cum = np.cumsum(freq) - freq
    of_slot = np.repeat(np.arange(len(symbols), dtype=np.int32), freq.astype(np.int64))
    state, at = states[pick].astype(np.uint64), bounds[pick].copy()
    found = np.empty((steps, len(pick), LANES), np.int32)
    for t in range(steps):
        slot = state & np.uint64(0xFFFF)
        found[t] = s = of_slot[slot]
        state = freq[s] * (state >> np.uint64(BITS)) + slot - cum[s]
        need = state < LOW
        rank = np.cumsum(need, axis=1)
        state = np.where(need, (state << np.uint64(BITS)) | words[np.minimum(at[:, None] + rank - 1, len(words) - 1)], state)
        at += rank[:, -1]
    ids = symbols[found.transpose(1, 0, 2).reshape(len(pick), -1)]
    size, crc, parts = steps * LANES, np.frombuffer(row["block_crc32"], "<u4"), []
    for k, b in enumerate(pick):
        part = ids[k, : max(0, min(size, n - int(b) * size))]
        if zlib.crc32(part.astype("<u4").tobytes()) != crc[b]:
            raise ValueError(f"block {b} fails its checksum")
        parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


FILE_SCHEMA = (
    "shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, steps bigint, symbols binary, frequencies binary, "
    "block_words binary, block_states binary, block_crc32 binary, words binary"
)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of every text, each with ``end_id`` behind it, in ascending doc_id order.

    Null text is empty, so it gives the end id alone; a null doc_id comes first; rows that repeat a doc_id stay
    side by side in no fixed order between different texts of one doc_id. No rows give files without segments; other columns are ignored.
    """
    name = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment = TaskContext.get().partitionId(), 0
        tok, held, ids, lengths = piece_tokenizer(name), 0, [], []
        names: list[int | None] = []

        def row() -> pa.RecordBatch:
            cols = {"shard": shard, "segment": segment, "doc_ids": names, "lengths": lengths} | encode_segment(np.concatenate(ids))
            return pa.RecordBatch.from_pylist([cols], schema=ARROW_FILE)

        for batch in batches:
            flat, sizes = tok.encode(batch.column(1))
            starts = np.cumsum(sizes) - sizes
            flat = np.insert(flat, starts + sizes, end_id)
            ends = np.cumsum(sizes + 1)
            doc_ids, at, base = batch.column(0).to_pylist(), 0, 0
            while at < len(ends):  # whole documents until the segment is full
                to = max(at + 1, int(np.searchsorted(ends, base + segment_ids - held, "right")))
                ids.append(flat[base : ends[to - 1]])
                names += doc_ids[at:to]
                lengths += (sizes[at:to] + 1).tolist()
                held += int(ends[to - 1]) - base
                at, base = to, int(ends[to - 1])
                if held >= segment_ids or at < len(ends):
                    yield row()
                    segment, held, ids, names, lengths = segment + 1, 0, [], [], []
        if ids:
            yield row()

    texts = docs.select("doc_id", text_of(docs).alias("text"))
    texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


ARROW_FILE = pa.schema(
    [
        pa.field(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[k])
        for n, k in (x.split(" ") for x in FILE_SCHEMA.split(", "))
    ]
)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, ids (binary, little-endian uint32; null without ``with_ids``)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = decode_segment(row).astype("<u4")
                ends = np.cumsum(row["lengths"])
                parts = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), row["lengths"])]
                k = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * k, pa.int32()), pa.array([row["segment"]] * k, pa.int32()),
                        pa.array(ends - np.asarray(row["lengths"]), pa.int64()), pa.array(row["lengths"], pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts if with_ids else [None] * k, pa.binary()),
                    ],
                    names=["doc_id", "shard", "segment", "inner", "n_tokens", "ids_crc32", "ids"],
                )

    per_segment = files.select("shard", "segment", "n_ids")
    shards = per_segment.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # one row for each file
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    starts = per_segment.withColumn("inside", inside).join(shards, "shard").select("shard", "segment", (F.col("inside") + F.col("base")).alias("first"))
    decoded = files.mapInArrow(decode, "doc_id bigint, shard int, segment int, inner bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return decoded.join(starts, ["shard", "segment"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path)
    return read_token_files(spark, path, with_ids=False).drop("ids")
