"""Token-id files: one wavelet matrix for each shard of documents.

File format (all numbers little-endian)::

    "WVM2" | u32 levels | u64 tokens | u64 documents | u32 directory size
    directory  zstd: documents + 1 offsets (i64), documents doc_ids (i64), documents bytes (1: doc_id is null)
    index      for each level from the top bit: u64 zeros, then for each block: u64 ones before it, u64 where it begins
    blocks     zstd: BLOCK bits each, packed big-endian

A level splits the sequence by one bit of the ids, stably, zeros before ones.  Ranks at every block are
in the file, and a block is inflated when it is asked for: ``access``, ``count`` and ``occurrence`` take
two blocks a level, whatever the shard's size, and a file can be mapped instead of read.

The shard table holds each file as a value, so that any store that Spark can write holds it; ``export``
writes them as files of their own, which need nothing else to be read.  Shards follow ascending doc_id;
documents are not split between shards.

Defined results: null and empty texts are the end id alone; null doc_ids come first; rows with one
doc_id follow each other in an order that is stable for one stored table; an empty table gives no
shards; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zlib
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens, words
from .common import partitions, saved

MAGIC = b"WVM2"
HEAD = struct.Struct("<4sIQQI")
#: Bits of a block, and blocks that an opened file keeps inflated.
BLOCK, KEPT = 1 << 15, 256
#: Tokens after which a shard ends; it still takes the whole of its last document.
SHARD_TOKENS = 1 << 20
#: A task here also codes its tokens, so that fewer words are to be encoded twice.
CACHE_WORDS = 1_000_000

SHARDS = "part int, shard int, n_docs long, n_tokens long, payload binary"
DOCUMENTS = "part int, shard int, doc_id long, within long, n_tokens long, ids binary"


def encode(ids: np.ndarray, offsets: np.ndarray, doc_ids: list[int | None] | None = None, levels: int | None = None) -> bytes:
    """The file for ``ids``; document i is ``ids[offsets[i]:offsets[i + 1]]``."""
    levels = levels or max(1, int(ids.max(initial=0)).bit_length())
    documents = len(offsets) - 1
    doc_ids = doc_ids if doc_ids is not None else [None] * documents
    names, null = np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8)
    press = zstandard.ZstdCompressor(1).compress
    directory = press(np.ascontiguousarray(offsets, "<i8").tobytes() + names.tobytes() + null.tobytes())
    index, blobs = [], []
    at = HEAD.size + len(directory) + levels * 8 * (1 + 2 * _blocks(len(ids)))
    current = ids.astype(np.uint16 if levels <= 16 else np.uint32, copy=False)
    for level in range(levels - 1, -1, -1):
        ones = ((current >> level) & 1).astype(bool)
        packed = np.packbits(ones)
        before = np.concatenate(([0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), BLOCK), dtype=np.int64)))) if len(ones) else np.zeros(1, np.int64)
        zeros = current[~ones]
        index.append(len(zeros))
        for i in range(_blocks(len(ids))):
            blob = press(packed[i * (BLOCK // 8) : (i + 1) * (BLOCK // 8)].tobytes())
            index += [int(before[i]), at]
            at += len(blob)
            blobs.append(blob)
        current = np.concatenate((zeros, current[ones]))
    return b"".join([HEAD.pack(MAGIC, levels, len(ids), documents, len(directory)), directory, np.array(index, "<u8").tobytes(), *blobs])


def _blocks(n: int) -> int:
    return -(-n // BLOCK)


class WaveletMatrix:
    """An opened file: bytes, or anything with a buffer, such as a mapped file."""

    def __init__(self, payload):
        self._file = memoryview(payload)
        magic, self.levels, self.n, self.documents, size = HEAD.unpack_from(self._file)
        if magic != MAGIC:
            raise ValueError("not a WVM2 file")
        raw = zstandard.ZstdDecompressor().decompress(self._file[HEAD.size : HEAD.size + size])
        numbers = np.frombuffer(raw, "<i8", 2 * self.documents + 1)
        self.offsets, names = numbers[: self.documents + 1], numbers[self.documents + 1 :]
        null = np.frombuffer(raw, np.uint8, self.documents, 8 * len(numbers))
        self.doc_ids = pa.array(names, mask=null.astype(bool))
        at, per = HEAD.size + size, 1 + 2 * _blocks(self.n)
        index = np.frombuffer(self._file, "<u8", self.levels * per, at).reshape(self.levels, per).astype(np.int64)
        self.zeros, self._before, where = index[:, 0].tolist(), index[:, 1::2], index[:, 2::2]
        self._where = np.append(where.ravel(), len(self._file))
        self._inflated: dict[int, np.ndarray] = {}
        self.n_inflated = 0

    def _block(self, k: int, i: int) -> np.ndarray:
        at = k * _blocks(self.n) + i
        if at not in self._inflated:
            if len(self._inflated) >= KEPT:
                del self._inflated[next(iter(self._inflated))]
            raw = zstandard.ZstdDecompressor().decompress(self._file[self._where[at] : self._where[at + 1]])
            self._inflated[at] = np.frombuffer(raw, np.uint8)
            self.n_inflated += 1
        return self._inflated[at]

    def _plane(self, k: int) -> np.ndarray:
        """All bits of a level; the blocks are not kept."""
        inflate, base = zstandard.ZstdDecompressor().decompress, k * _blocks(self.n)
        raw = b"".join(inflate(self._file[self._where[base + i] : self._where[base + i + 1]]) for i in range(_blocks(self.n)))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).astype(bool)

    def all(self) -> np.ndarray:
        """Every token: the levels are undone from the lowest bit up."""
        values = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for k in range(self.levels - 1, -1, -1):
            ones, up = self._plane(k), np.empty_like(values)
            up[~ones] = values[: self.zeros[k]]
            up[ones] = values[self.zeros[k] :] | values.dtype.type(1 << (self.levels - 1 - k))
            values = up
        return values.astype(np.uint32)

    def _rank(self, k: int, i: int) -> int:
        """Ones before position i of level k."""
        if i >= self.n:
            return self.n - self.zeros[k]
        bits, byte = self._block(k, i // BLOCK), i % BLOCK // 8
        total = int(self._before[k, i // BLOCK]) + int(np.bitwise_count(bits[:byte]).sum(dtype=np.int64))
        return total + (int(bits[byte]) >> (8 - i % 8)).bit_count() if i % 8 else total

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) such bit of level k: the block by its rank, then inside it."""
        before = self._before[k] if bit else np.arange(_blocks(self.n)) * BLOCK - self._before[k]
        i = int(np.searchsorted(before, j, "right")) - 1
        bits = np.unpackbits(self._block(k, i))[: self.n - i * BLOCK]
        return i * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[i])])

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.levels):
            ones = self._rank(k, i)
            bit = self._rank(k, i + 1) - ones
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self._rank(k, low), self._rank(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.levels - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` stands in [low, high)."""
        if token >> self.levels:
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        if token >> self.levels or j < 0:
            return -1
        a, b = self._range(token, 0, self.n)
        if a + j >= b:
            return -1
        i = a + j
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    encoder, part, shard = tokens.encoder(path, end_id, CACHE_WORDS), TaskContext.get().partitionId(), 0
    levels = (encoder.vocabulary - 1).bit_length()
    docs: list[np.ndarray] = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    total = 0

    def flush() -> pa.RecordBatch:
        ids, lengths = np.concatenate(held), np.concatenate(sizes)
        payload = encode(ids, np.concatenate(([0], np.cumsum(lengths))), pa.concat_arrays(docs).to_pylist(), levels)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(lengths)]), pa.array([len(ids)]), pa.array([payload], pa.binary())], names=["part", "shard", "n_docs", "n_tokens", "payload"])

    for batch in batches:
        for piece in words.chunks(batch, "text"):
            ids, at = encoder.encode(piece.column("text"))
            ids = ids.astype(np.uint16) if levels <= 16 else ids
            first, n = 0, piece.num_rows
            while first < n:
                last = min(n, max(first + 1, int(np.searchsorted(at, at[first] + shard_tokens - total, "left"))))
                docs.append(piece.column("doc_id").slice(first, last - first))
                held.append(ids[at[first] : at[last]])
                sizes.append(np.diff(at[first : last + 1]))
                total += int(at[last] - at[first])
                first = last
                if total >= shard_tokens:
                    yield flush()
                    shard, total = shard + 1, 0
                    docs, held, sizes = [], [], []
    if docs:
        yield flush()


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Tokenise ``docs`` and write the shard files, in ascending doc_id order (part, then shard)."""
    path = path or tokens.default_path()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return saved(ordered.mapInArrow(lambda batches: _write(batches, path, end_id, shard_tokens), SHARDS), "shards")


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {n: batch.column(n)[r] for n in ("part", "shard", "payload")}
            matrix = WaveletMatrix(row["payload"].as_buffer())
            ids, at, doc_ids = matrix.all().astype("<u4"), matrix.offsets, matrix.doc_ids
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = len(at) - 1
            columns = [pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["shard"].as_py()] * n, pa.int32()), doc_ids, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
            names = ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, tokens.blobs(ids, at)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    spark = shards.sparkSession
    totals = sorted((r.part, r.shard, r.n_tokens) for r in _totals(shards).collect())
    before = [0, *accumulate(t for _, _, t in totals)][: len(totals)]
    bases = spark.createDataFrame([(p, b) for (p, _, _), b in zip(totals, before, strict=True)], "part int, base long")
    # Parts are tasks, so the driver sees one number for each task, never one for each document or shard.
    inside = shards.selectExpr("part AS p", "shard AS s", "coalesce(sum(n_tokens) OVER (PARTITION BY part ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    schema = "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    read = shards.select("part", "shard", "payload").mapInArrow(lambda batches: _read(batches, with_ids), schema)
    out = read.join(inside, (read.part == inside.p) & (read.shard == inside.s)).join(F.broadcast(bases), "part")
    return out.selectExpr("doc_id", "base + before + within AS start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def export(shards: DataFrame, folder: str) -> DataFrame:
    """part, shard, file, bytes: each shard written to ``folder`` (a path or uri that all executors share) as a file of its own.

    Names and contents depend on the shard alone, so a task that is run again writes the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c) for c in ("part", "shard", "payload")), strict=True):
                name = f"{part.as_py():05d}-{shard.as_py():05d}.wvm"
                with store.open_output_stream(f"{root}/.{name}.{TaskContext.get().taskAttemptId()}") as out:
                    out.write(payload.as_buffer())
                store.move(f"{root}/.{name}.{TaskContext.get().taskAttemptId()}", f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([shard.as_py()], pa.int32()), pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([payload.as_buffer().size])], names=["part", "shard", "file", "bytes"])

    return shards.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, file string, bytes long")


def _totals(shards: DataFrame) -> DataFrame:
    return shards.groupBy("part").agg(F.lit(0).alias("shard"), F.sum("n_tokens").alias("n_tokens"))
