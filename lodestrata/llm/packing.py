"""Token ids as binary files: fixed-width bit packing with block offsets.

A file holds the documents of one range of doc_id in ascending order:

    b"LDPK"  version:u8  bits:u8  block:u32            header, 10 bytes
    blocks   of ``block`` ids each (the last may be shorter), every id in ``bits`` bits, least bit first
    offsets  u64 * blocks      where each block begins in the file
    docs     i64 * docs        doc_id (null: the smallest 64-bit value, with its flag in ``nulls``)
    starts   u64 * (docs + 1)  first id of each document among the ids of the file
    nulls    u8 * docs
    footer   offsets_at:u64  blocks:u64  docs:u64  ids:u64  b"LDPK"

Any range of ids is found by one seek: block = i // block, its place = offsets[block]; a block unpacks with numpy at
once. Files are named at random by each task attempt; the manifest (one row a file, written by Spark) lists those of
attempts that succeeded, so a lost executor leaves orphans at worst, never wrong rows.

Defined cases: null text is empty and gives the end id alone; null ids come first in order; rows with equal ids stand
next to one another, in no set order; an empty table gives no documents.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, id_text, scratch, written
from .encoding import tokenizer_of

MAGIC, HEAD, FOOT = b"LDPK", struct.Struct("<4sBBI"), struct.Struct("<QQQQ4s")
#: Ids in a block.
BLOCK = 1 << 16
_NULL = np.iinfo(np.int64).min


def min_bits(vocabulary_size: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (max(1, vocabulary_size) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least bit first, filled up to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class PackedWriter:
    """Appends documents to a file, holding one block of ids."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.stream.write(HEAD.pack(MAGIC, 1, bits, block))
        self.at, self.rest, self.ids = HEAD.size, np.zeros(0, np.uint32), 0
        self.offsets: list[int] = []
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []

    def _flush(self, block: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.stream.write(raw := pack(block, self.bits))
        self.at += len(raw)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.nulls.append(nulls)
        self.sizes.append(sizes)
        self.ids += len(flat)
        ids = np.concatenate([self.rest, flat])
        whole = len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self._flush(ids[i : i + self.block])
        self.rest = ids[whole:]

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._flush(self.rest)
        sizes = np.concatenate([np.zeros(1, np.int64), *self.sizes])
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(np.concatenate([np.zeros(0, np.int64), *self.docs]).astype("<i8").tobytes())
        self.stream.write(np.cumsum(sizes).astype("<u8").tobytes())
        self.stream.write(np.concatenate([np.zeros(0, bool), *self.nulls]).astype(np.uint8).tobytes())
        self.stream.write(FOOT.pack(self.at, len(self.offsets), len(sizes) - 1, self.ids, MAGIC))
        return len(sizes) - 1, self.ids


class PackedReader:
    """Random access to a packed file; ``stream`` is any seekable file."""

    def __init__(self, stream):
        self.stream = stream
        magic, version, self.bits, self.block = HEAD.unpack(self._read(0, HEAD.size))
        stream.seek(0, 2)
        end = stream.tell()
        at, blocks, docs, self.ids, tail = FOOT.unpack(self._read(end - FOOT.size, FOOT.size))
        if magic != MAGIC or tail != MAGIC or version != 1:
            raise ValueError("not a packed token file")
        self.offsets = np.append(np.frombuffer(self._read(at, 8 * blocks), "<u8"), at).astype(np.int64)
        self.docs = np.frombuffer(self._read(at + 8 * blocks, 8 * docs), "<i8")
        self.starts = np.frombuffer(self._read(at + 8 * (blocks + docs), 8 * (docs + 1)), "<u8").astype(np.int64)
        self.nulls = np.frombuffer(self._read(at + 8 * (blocks + 2 * docs + 1), docs), np.uint8).astype(bool)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        raw = self._read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        base, out = int(self.offsets[first]), []
        for b in range(first, last + 1):
            n = min(self.block, self.ids - b * self.block)
            out.append(unpack(raw[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], n, self.bits))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))


def _open(path: str, write: bool = False):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(name.rpartition("/")[0], recursive=True)
        return system.open_output_stream(name)
    return system.open_input_file(name)


def write_packed(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 22) -> DataFrame:
    """Encodes ``docs`` and writes packed files under ``path`` in ascending order of id; returns the manifest.

    One range shuffle of the texts; encoding, packing and writing share the stage after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer_of(vocabulary)
        bits = min_bits(max(encoder.tokenizer.get_vocab_size(), (end_id or 0) + 1))
        out = writer = None
        name, low = f"{path}/part-{uuid.uuid4().hex}.ldpk", _NULL
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for s in byte_slices(sizes, batch_bytes):
                part = batch.slice(s.start, s.stop - s.start)
                flat, n = encoder.encode(part.column(1))
                if end_id is not None:
                    flat, n = np.insert(flat, np.cumsum(n), end_id).astype(np.uint32), n + 1
                nulls = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
                if writer is None:
                    out, low = _open(name, write=True), int(ids[0])
                    writer = PackedWriter(out, bits)
                writer.add(ids, nulls, flat, n)
        if writer is not None:
            docs_n, ids_n = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "first_id": [low], "docs": [docs_n], "ids": [ids_n]}, schema=pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    dealt = id_text(docs, id_col, text_col).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return written(dealt.mapInArrow(run, "path string, first_id long, docs long, ids long"), "manifest")


def read_packed(manifest: DataFrame, batch_ids: int = 1 << 21, with_ids: bool = False) -> DataFrame:
    """One row per document from the files of a manifest: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, if asked for, ids. Only file rows, not documents, meet in the running sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(path) as stream:
                    f = PackedReader(stream)
                    k = 0
                    while k < len(f.docs):
                        to = max(k + 1, int(np.searchsorted(f.starts, f.starts[k] + batch_ids, "right")) - 1)
                        ids, cuts = f.range(int(f.starts[k]), int(f.starts[to])), f.starts[k : to + 1] - f.starts[k]
                        raw = memoryview(ids.astype("<u4").tobytes())
                        cols = [
                            pa.array(f.docs[k:to], pa.int64(), mask=f.nulls[k:to]),
                            pa.array(f.starts[k:to] + base, pa.int64()),
                            pa.array(np.diff(cuts), pa.int64()),
                            pa.array([zlib.crc32(raw[4 * int(a) : 4 * int(b)]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                        ]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int64())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names=names)
                        k = to

    before = F.coalesce(F.sum("ids").over(Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before.cast("long")).select("path", "base")
    more = ", ids array<long>" if with_ids else ""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + more)


def packed_path(spark: SparkSession) -> str:
    return scratch(spark, "packed")
