"""Token ids in plane-shuffled binary shards.

A shard holds the ids of consecutive documents.  Ids are cut into blocks of a fixed number; a block is transposed into
byte planes (or bit planes), each plane is compressed with zstandard by itself, and the footer keeps the chunk index
(where each plane of each block lies) and the document index (id, first id in the shard, number of ids).

    magic | block 0 plane 0 | block 0 plane 1 | ... | zstd(footer) | footer size (u64) | magic

Documents are dealt to writers by ranges of doc_id, so shard order is id order; the ids before a shard are a running
sum over the shard manifest, which has one row per shard.

Defined cases: a null text is the empty text and yields the end id alone; null ids come first; rows that repeat a
doc_id are all written, ordered by the text's hash and the text among themselves; an empty table gives no shard and no row; a
very long text is encoded whole, by itself; columns other than id and text are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velith.llm import blobs
from velith.llm.common import materialise, scratch_path, slices, texts_of
from velith.llm.piecewise import byte_bpe

MAGIC = b"VLPLANE1"
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 24


def split_planes(ids: np.ndarray, plane: str = "byte") -> list[bytes]:
    """Planes of a block of uint32 ids, least significant first: 4 byte planes or 32 bit planes."""
    if plane == "byte":
        table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
        return [np.ascontiguousarray(row).tobytes() for row in table]
    bits = (ids.astype("<u4")[None, :] >> np.arange(32, dtype=np.uint32)[:, None]) & 1
    return [np.packbits(row.astype(np.uint8)).tobytes() for row in bits]


def join_planes(planes: list[bytes], n: int, plane: str = "byte") -> np.ndarray:
    """The inverse of :func:`split_planes`."""
    if plane == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1) if n else np.zeros(0, "<u4")
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


class ShardWriter:
    """Appends documents to one shard file; memory holds a block of ids and the indexes."""

    def __init__(self, folder: str, plane: str, block_ids: int, level: int):
        self.uri, self.out = blobs.create(folder, ".vlp")
        self.plane, self.block_ids, self.zstd = plane, block_ids, zstandard.ZstdCompressor(level=level)
        self.pending, self.held, self.n_ids, self.at = [], 0, 0, len(MAGIC)
        self.chunks: list[tuple[int, list[tuple[int, int]]]] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, self.n_ids, n))
        self.n_ids += n
        self.pending.append(ids)
        self.held += n
        if self.held >= self.block_ids:
            whole = np.frombuffer(b"".join(self.pending), "<u4")
            full = len(whole) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(whole[k : k + self.block_ids])
            self.pending, self.held = [whole[full:].tobytes()], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        places = []
        for plane in split_planes(ids, self.plane):
            packed = self.zstd.compress(plane)
            self.out.write(packed)
            places.append((self.at, len(packed)))
            self.at += len(packed)
        self.chunks.append((len(ids), places))

    def close(self) -> tuple[str, int, int, int]:
        """(uri, ids, documents, bytes)"""
        if self.held:
            self._block(np.frombuffer(b"".join(self.pending), "<u4"))
        planes = 4 if self.plane == "byte" else 32
        head = struct.pack("<IIQQ", planes, self.block_ids, len(self.chunks), len(self.docs))
        sizes = np.array([n for n, _ in self.chunks], "<u8").tobytes()
        places = np.array([p for _, x in self.chunks for p in x], "<u8").tobytes()
        known = np.array([d is not None for d, _, _ in self.docs], np.uint8).tobytes()
        docs = np.array([(d or 0, a, n) for d, a, n in self.docs], "<i8").tobytes()
        footer = self.zstd.compress(head + sizes + places + known + docs)
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        return self.uri, self.n_ids, len(self.docs), self.at + len(footer) + 16


class ShardReader:
    """Random access to one shard through its indexes."""

    def __init__(self, uri: str):
        self.file = blobs.open_input(uri)
        size = self.file.size()
        self.file.seek(size - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a whole shard: {uri}")
        length = struct.unpack("<Q", tail[:8])[0]
        self.file.seek(size - 16 - length)
        self.zstd = zstandard.ZstdDecompressor()
        data = self.zstd.decompress(self.file.read(length))
        self.planes, self.block_ids, n_chunks, n_docs = struct.unpack_from("<IIQQ", data)
        at = 24
        self.sizes = np.frombuffer(data, "<u8", n_chunks, at).astype(np.int64)
        at += 8 * n_chunks
        self.places = np.frombuffer(data, "<u8", n_chunks * self.planes * 2, at).reshape(n_chunks, self.planes, 2)
        at += 16 * n_chunks * self.planes
        self.known = np.frombuffer(data, np.uint8, n_docs, at).astype(bool)
        self.docs = np.frombuffer(data, "<i8", n_docs * 3, at + n_docs).reshape(n_docs, 3)

    def block(self, k: int) -> np.ndarray:
        n, planes = int(self.sizes[k]), []
        first, last = self.places[k][0], self.places[k][-1]
        self.file.seek(int(first[0]))
        data = self.file.read(int(last[0] + last[1] - first[0]))
        for place, size in self.places[k]:
            planes.append(self.zstd.decompress(data[int(place - first[0]) : int(place - first[0] + size)]))
        return join_planes(planes, n, "byte" if self.planes == 4 else "bit")

    def documents(self):
        """(doc_id, first id in the shard, ids) in the order written."""
        held, base, k = np.zeros(0, "<u4"), 0, 0
        for known, (doc, start, n) in zip(self.known.tolist(), self.docs.tolist(), strict=True):
            if start + n > base + len(held):
                parts = [held[start - base :]]
                have, base = len(parts[0]), start
                while have < n:
                    parts.append(self.block(k))
                    have += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield (doc if known else None), start, held[start - base : start - base + n]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", plane: str = "byte", block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS, level: int = 1) -> DataFrame:
    """Write the shards and return their manifest in id order: part, seq, uri, n_ids, n_docs, bytes, start."""

    def run(batches):
        bpe, end, writer, seq = byte_bpe(tokenizer), struct.pack("<I", end_id), None, 0
        part, done = TaskContext.get().partitionId(), []
        for batch in slices(batches, 128):
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts_of(batch.column(1))), strict=True):
                writer = writer or ShardWriter(folder, plane, block_ids, level)
                writer.add(doc, ids + end)
                if writer.n_ids >= shard_ids:
                    done.append((part, seq, *writer.close()))
                    writer, seq = None, seq + 1
        if writer:
            done.append((part, seq, *writer.close()))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=["part", "seq", "uri", "n_ids", "n_docs", "bytes"])

    # The text's hash splits rows that share an id, or have none, over as many writers as they need.
    keyed = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).withColumn("_velith_h", F.xxhash64(text_col))
    ranged = keyed.repartitionByRange(id_col, "_velith_h").sortWithinPartitions(id_col, "_velith_h", text_col).drop("_velith_h")
    manifest = materialise(ranged.mapInArrow(run, "part int, seq int, uri string, n_ids long, n_docs long, bytes long"), "manifest")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard, not per document
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("long")))


def read_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document from the files: id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(doc, base + start, len(ids), zlib.crc32(ids.tobytes())) for doc, start, ids in ShardReader(uri).documents()]
                for k in range(0, len(rows), 50_000):
                    part = rows[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], pa.int64()) for c in range(4)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("uri", "start").repartition(max(1, manifest.count()), "uri")
    return spread.mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def read_ids(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document from the files: id, start and the ids themselves."""

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for doc, start, ids in ShardReader(uri).documents():
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([base + start], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=[id_col, "start", "ids"])

    return manifest.select("uri", "start").repartition(max(1, manifest.count()), "uri").mapInArrow(run, f"{id_col} long, start long, ids array<long>")


def token_table(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write all documents as shards in the shared folder and read every one back from the files."""
    return read_shards(write_shards(docs, tokenizer, end_id, scratch_path(docs.sparkSession, "shards"), **options))
