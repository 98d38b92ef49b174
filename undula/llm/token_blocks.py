"""Token ids as patched frame-of-reference blocks.

A shard file holds the ids of consecutive documents. Ids are cut into blocks of BLOCK. Each block has its minimum
subtracted and is packed at the bit width that `percentile` of its values need; the high bits of the others stand
in an exception list. Every segment of SEGMENT blocks carries the word at which each of its blocks starts, and the
footer the byte at which each segment starts, so any run of ids can be read without the rest.

    magic | segments | footer | footer length (u64) | magic
    segment: ids u32, exceptions u32 | minimum u32[b] | width u8[b] | start u32[b + 1] | exceptions u32[b]
             | packed u32[start[b]] | exception place u16[e] | exception high bits u32[e]
    footer:  documents u64, segments u64, ids u64 | doc_id i64[d] | doc_id known u8[d] | length u64[d]
             | segment start u64[s] | ids before it u64[s]

All numbers are little-endian. Files are written whole under a name that no other attempt uses, and count only once
Spark commits the attempt's row in the manifest, so a lost executor or a second attempt leaves nothing half done.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import shared
from undula.llm.tokens import encoder

MAGIC, BLOCK, SEGMENT = b"PFORIDS1", 128, 2048
MANIFEST = "part int, path string, n_docs long, n_ids long"
_HEAD, _FOOT = struct.Struct("<II"), struct.Struct("<QQQ")


def bit_length(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values: (BLOCK, blocks) below 2**width. Returns (blocks, BLOCK * width / 32) words."""
    words = np.zeros((BLOCK * width // 32, values.shape[1]), np.uint32)
    for k in range(BLOCK):
        word, bit = divmod(k * width, 32)
        words[word] |= values[k] << np.uint32(bit)
        if bit + width > 32:
            words[word + 1] |= values[k] >> np.uint32(32 - bit)
    return words.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _pack; returns (blocks, BLOCK)."""
    words = np.ascontiguousarray(words.T)
    values = np.empty((BLOCK, words.shape[1]), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(BLOCK):
        word, bit = divmod(k * width, 32)
        values[k] = words[word] >> np.uint32(bit)
        if bit + width > 32:
            values[k] |= words[word + 1] << np.uint32(32 - bit)
        values[k] &= mask
    return values.T


def encode_segment(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """ids: at least one, at most SEGMENT * BLOCK unsigned 32-bit integers."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    table = np.full(blocks * BLOCK, ids[-1], np.uint32)
    table[:n] = ids
    table = table.reshape(blocks, BLOCK)
    least = table.min(axis=1)
    over = table - least[:, None]
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    width = bit_length(np.partition(over, rank, axis=1)[:, rank])
    high = (over.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    where, place = np.nonzero(high)
    start = np.zeros(blocks + 1, np.uint32)
    np.cumsum(width.astype(np.uint32) * (BLOCK // 32), out=start[1:])
    packed = np.empty(int(start[-1]), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            low = over[rows] & np.uint32((1 << int(w)) - 1)
            to = start[rows][:, None] + np.arange(BLOCK // 32 * int(w), dtype=np.uint32)
            packed[to] = _pack(np.ascontiguousarray(low.T), int(w))
    count = np.bincount(where, minlength=blocks).astype("<u4")
    parts = (least.astype("<u4"), width, start.astype("<u4"), count, packed.astype("<u4"), place.astype("<u2"), high[where, place].astype("<u4"))
    return _HEAD.pack(n, len(where)) + b"".join(x.tobytes() for x in parts)


def decode_segment(data: bytes | memoryview) -> np.ndarray:
    n, exceptions = _HEAD.unpack_from(data, 0)
    blocks, at = -(-n // BLOCK), _HEAD.size

    def take(kind: str, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, size, at)
        at += out.nbytes
        return out

    least, width, start, count = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1), take("<u4", blocks)
    packed = take("<u4", int(start[-1]))
    place, high = take("<u2", exceptions), take("<u4", exceptions)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            out[rows] = _unpack(packed[start[rows][:, None] + np.arange(BLOCK // 32 * int(w))], int(w))
    where = np.repeat(np.arange(blocks), count)
    out[where, place] |= (high.astype(np.uint64) << width[where].astype(np.uint64)).astype(np.uint32)
    return (out + least[:, None]).reshape(-1)[:n]


class ShardWriter:
    """Takes documents one after another; holds one segment of ids and the documents' lengths."""

    def __init__(self, sink, percentile: float):
        self.sink, self.percentile = sink, percentile
        self.at = self.done = self.held_ids = 0
        self.held: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.starts: list[int] = []
        self.before: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= SEGMENT * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, full = np.concatenate(self.held or [np.empty(0, np.uint32)]), SEGMENT * BLOCK
        end = len(ids) if last else len(ids) // full * full
        for k in range(0, end, full):
            self.starts.append(self.at)
            self.before.append(self.done + k)
            self._put(encode_segment(ids[k : min(k + full, end)], self.percentile))
        self.done += end
        self.held, self.held_ids = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        begin = self.at
        self._put(_FOOT.pack(len(self.docs), len(self.starts), self.done))
        self._put(np.array([x or 0 for x in self.docs], "<i8").tobytes() + np.array([x is not None for x in self.docs], "u1").tobytes())
        self._put(np.array(self.lengths, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.before, "<u8").tobytes())
        self._put(struct.pack("<Q", self.at - begin) + MAGIC)


class ShardReader:
    """Random access to a shard; source: an open file that can seek."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard of token blocks")
        length = struct.unpack("<Q", tail[:8])[0]
        self.footer = end - 16 - length
        source.seek(self.footer)
        data = source.read(length)
        docs, segments, self.n_ids = _FOOT.unpack_from(data)
        at = _FOOT.size
        ids = np.frombuffer(data, "<i8", docs, at)
        known = np.frombuffer(data, "u1", docs, at + 8 * docs)
        at += 9 * docs
        self.lengths = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", segments, at + 8 * docs).astype(np.int64)
        self.before = np.frombuffer(data, "<u8", segments, at + 8 * (docs + segments)).astype(np.int64)
        self.docs = [int(x) if k else None for x, k in zip(ids, known, strict=True)]

    def segment(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else self.footer
        self.source.seek(int(self.starts[k]))
        return decode_segment(self.source.read(int(end - self.starts[k])))

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the shard on, from the segments that hold them."""
        if n <= 0:
            return np.empty(0, np.uint32)
        first = int(np.searchsorted(self.before, start, "right")) - 1
        last = int(np.searchsorted(self.before, start + n, "left")) - 1
        found = np.concatenate([self.segment(k) for k in range(first, last + 1)])
        return found[start - self.before[first] :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place in the shard and ids of each document, a segment at a time."""
        held, at, k = np.empty(0, np.uint32), 0, 0
        for doc_id, n in zip(self.docs, self.lengths.tolist(), strict=True):
            more = [held]
            have = len(held)
            while have < n:
                more.append(self.segment(k))
                have += len(more[-1])
                k += 1
            held = np.concatenate(more) if len(more) > 1 else held
            yield doc_id, at, held[:n]
            held, at = held[n:], at + n


def write(docs: DataFrame, folder: str, end_id: int = 2, percentile: float = 0.9, vocabulary: str | None = None) -> DataFrame:
    """Encodes documents(doc_id, text) into shards below folder, in ascending doc_id order, each with end_id after it.

    Returns the manifest (part, path, n_docs, n_ids), stored. Null text is empty; a null doc_id comes first; rows of
    one doc_id are ordered by their text's hash, and repeated rows are all written. An empty table gives an empty manifest.
    """
    shared.bounded_batches(docs.sparkSession)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        for batch in shared.parts(batches, "text", 4 << 20):
            if writer is None:
                files, base = pa.fs.FileSystem.from_uri(folder)
                files.create_dir(base)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
                sink = files.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(sink, percentile)
            ids, ends = encoder(vocabulary).encode(batch.column("text"), end_id)
            for doc_id, at, end in zip(batch.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                writer.add(doc_id, ids[at:end])
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.done]})

    rows = shared.text_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]  # hashes, so that the sample that finds the ranges holds no texts
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return shared.stored(ordered.mapInArrow(shared.released(shard), MANIFEST), "token-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32, shard. The manifest has a row per shard, and
    its running sum of ids, taken on the driver, is all that the shards' order needs."""
    total, shards = 0, []
    for row in manifest.orderBy("part").collect():
        shards.append((row.path, total))
        total += row.n_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                files, place = pa.fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as source:
                    found = [(d, before + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in ShardReader(source).documents()]
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([path] * len(found))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    table = spark.createDataFrame(shards, "path string, before long")
    return table.repartition(max(1, len(shards))).mapInArrow(shared.released(scan), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_files(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the shards and reads them back; see write() and read()."""
    folder = folder or shared.scratch(spark, "token-blocks")
    return read(spark, write(docs, folder, **options))
