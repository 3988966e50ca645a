"""Token ids in binary files of fixed-width bit-packed blocks (operator 3).

A shard is one file: a header, the blocks, and a footer. A block has BLOCK ids (the last one fewer),
each in the fewest bits that hold the vocabulary, least significant bit first. The footer has each
block's byte offset, and each document's id, null flag and first token, and it ends with the
counts, so a reader can seek to any token, block or document and unpack it by numpy alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, slices, stored
from .library_tokens import library_ids

MAGIC, HEADER, TAIL = b"SYLVTOK1", struct.Struct("<8sII"), struct.Struct("<QQQQ")
BLOCK = 1 << 14
#: A shard ends with the document that brings it to this many tokens.
SHARD_TOKENS = 1 << 23
MANIFEST = "path string, first_doc bigint, partition int, shard int, n_docs bigint, n_tokens bigint"


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if width == 16:
        return raw[: 2 * count].view("<u2").astype(np.uint32)
    bits = np.zeros((count, 32), np.uint8)
    bits[:, :width] = np.unpackbits(raw, count=count * width, bitorder="little").reshape(count, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_shard(path: str, docs: list[tuple[int | None, np.ndarray]], width: int) -> int:
    """Write (doc_id, ids) pairs in the order given; returns the number of tokens."""
    store, name = _filesystem(path)
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32)
    starts = np.cumsum([0, *(len(x) for _, x in docs)]).astype("<u8")
    offsets = []
    with store.open_output_stream(name) as out:
        out.write(HEADER.pack(MAGIC, width, BLOCK))
        at = HEADER.size
        for i in range(0, len(ids), BLOCK):
            offsets.append(at)
            data = pack_bits(ids[i : i + BLOCK], width)
            out.write(data)
            at += len(data)
        out.write(np.array(offsets, "<u8").tobytes() + np.array([d or 0 for d, _ in docs], "<i8").tobytes())
        out.write(np.array([d is None for d, _ in docs], "u1").tobytes() + starts.tobytes())
        out.write(TAIL.pack(at, len(offsets), len(docs), len(ids)))
    return len(ids)


class Shard:
    """Random access to one file; only the blocks asked for are read."""

    def __init__(self, path: str) -> None:
        store, name = _filesystem(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        magic, self.width, self.block = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.end, n_blocks, n_docs, self.n_tokens = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        foot = self.file.read_at(size - TAIL.size - self.end, self.end)
        at = iter(np.cumsum([0, 8 * n_blocks, 8 * n_docs, n_docs, 8 * n_docs + 8]).tolist())
        i = next(at)
        parts = []
        for kind in ("<u8", "<i8", "u1", "<u8"):
            j = next(at)
            parts.append(np.frombuffer(foot[i:j], kind))
            i = j
        self.offsets, ids, none, self.starts = parts
        self.docs = [None if x else int(d) for d, x in zip(ids, none, strict=True)]

    def tokens(self, begin: int, end: int) -> np.ndarray:
        if end <= begin:
            return np.empty(0, np.uint32)
        a, b = begin // self.block, (end - 1) // self.block + 1
        first = int(self.offsets[a])
        last = int(self.offsets[b]) if b < len(self.offsets) else self.end
        data, count = self.file.read_at(last - first, first), min(b * self.block, self.n_tokens) - a * self.block
        if self.block * self.width % 8 == 0:
            ids = unpack_bits(data, count, self.width)
        else:  # each block then starts on a byte of its own
            step = int(self.offsets[a + 1]) - first if b - a > 1 else len(data)
            ids = np.concatenate([unpack_bits(data[k * step : (k + 1) * step], min(self.block, count - k * self.block), self.width) for k in range(b - a)])
        return ids[begin - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write every document's ids and ``end_id``, in ascending id order (null ids first), and return the manifest.

    The range exchange puts equal ids together, so shards don't overlap. A task that is run again
    writes files with new names, and only the files of the attempt that counts get into the stored
    manifest. A null or empty text is the end id alone; repeated rows are written each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = library_ids(tokenizer), TaskContext.get().partitionId()
        store, name = _filesystem(folder)
        store.create_dir(name)
        if end_id >= encoder.vocab_size:
            raise ValueError(f"the end id {end_id} is outside the vocabulary")
        held: list[tuple[int | None, np.ndarray]] = []
        total = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal total, shard
            path = f"{folder.rstrip('/')}/shard-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.tok"
            n = write_shard(path, held, bits_for(encoder.vocab_size))
            row = {"path": path, "first_doc": held[0][0], "partition": part, "shard": shard, "n_docs": len(held), "n_tokens": n}
            held.clear()
            total, shard = 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([row[x.split()[0]]], t) for x, t in zip(MANIFEST.split(", "), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(x) for x in texts]):
                for doc, tokens in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    held.append((doc, np.append(tokens, end_id).astype(np.uint32)))
                    total += len(tokens) + 1
                    if total >= shard_tokens:
                        yield flush()
        if held:
            yield flush()

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files that the manifest names.

    ``start`` counts the ids of all documents before it. A task reads one shard at a time, block by
    block; the manifest has one row a shard.
    """
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "partition", "shard").rowsBetween(Window.unboundedPreceding, -1)
    spark = manifest.sparkSession
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                crcs, block_docs = [], 4096
                for i in range(0, len(shard.docs), block_docs):
                    ends = shard.starts[i : i + block_docs + 1].astype(np.int64)
                    ids = shard.tokens(int(ends[0]), int(ends[-1])).astype("<u4")
                    crcs += [zlib.crc32(ids[a - ends[0] : b - ends[0]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                starts = shard.starts.astype(np.int64)
                arrays = [pa.array(shard.docs, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
                shard.close()
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read(write(docs, tokenizer, new_folder(docs.sparkSession, "tokens"), end_id, id_col, text_col))


def describe(path: str) -> str:
    """A shard's header and counts, as JSON."""
    shard = Shard(path)
    out = {"bits": shard.width, "block": shard.block, "blocks": len(shard.offsets), "docs": len(shard.docs), "tokens": shard.n_tokens}
    shard.close()
    return json.dumps(out)
