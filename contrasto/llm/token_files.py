"""Token-id files: fixed-width bit packing with block offsets.

A file holds documents in ascending doc_id order.  Each id takes the least bits that hold every id of the
vocabulary; blocks of a fixed number of ids start at whole bytes, and a table of their offsets lets a reader unpack any
range of ids with vectorised numpy.  Layout (little-endian):

    magic "CTOK0001"
    blocks
    block offsets          u64 x (blocks + 1)
    doc ids                i64 x documents
    null flags of doc ids  u8 x documents
    document starts        u64 x (documents + 1), in ids of this file
    trailer                u64 x 6: documents, ids, blocks, bits, block size, position of the block offsets; magic

Defined cases: null text is empty (its end id alone); null doc_ids come first; rows with one id are ordered by their
text, and repeated rows are written each for itself; a very long text spans many blocks, which readers take a bounded number of ids at a time; an empty table gives no rows; further columns are ignored.  A task writes under a name of its own attempt
and renames at the end, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contrasto.llm.common import batch, materialize, new_path, text_rows
from contrasto.llm.tokens import END_ID, TOKENIZER, encoder

MAGIC = b"CTOK0001"
BLOCK = 8192
_TRAILER = struct.Struct("<6Q8s")
FILES = pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("bits", pa.int64())])
FILES_DDL = "file string, part long, n_docs long, n_ids long, n_bytes long, bits long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def bits_for(vocab_size: int) -> int:
    """The least bits for ids 0 to vocab_size - 1."""
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class TokenFileWriter:
    """Documents to a binary file object."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.at = out.write(MAGIC)
        self.offsets, self.doc_ids, self.nulls, self.starts = [self.at], [], [], [0]
        self.waiting: list[bytes] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: bytes of little-endian unsigned 32-bit integers."""
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= 64 * self.block:
            self._blocks(self.n_waiting // self.block * self.block)

    def _blocks(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        for lo in range(0, n, self.block):
            self.at += self.out.write(pack_bits(ids[lo : min(n, lo + self.block)], self.bits))
            self.offsets.append(self.at)
        self.waiting, self.n_waiting = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> dict:
        if self.n_waiting:
            self._blocks(self.n_waiting)
        tail = np.array(self.offsets, "<u8").tobytes() + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.starts, "<u8").tobytes()
        tail += _TRAILER.pack(len(self.doc_ids), self.starts[-1], len(self.offsets) - 1, self.bits, self.block, self.at, MAGIC)
        self.out.write(tail)
        return {"n_docs": len(self.doc_ids), "n_ids": self.starts[-1], "n_bytes": self.at + len(tail), "bits": self.bits}


class TokenFile:
    """Random access to a token-id file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.n_docs, self.n_ids, self.n_blocks, self.bits, self.block, at, magic = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        tail = self._read(at, size - _TRAILER.size - at)
        part = lambda lo, n, kind: (np.frombuffer(tail, kind, n, lo), lo + n * np.dtype(kind).itemsize)
        self.offsets, lo = part(0, self.n_blocks + 1, "<u8")
        self.doc_ids, lo = part(lo, self.n_docs, "<i8")
        self.nulls, lo = part(lo, self.n_docs, "u1")
        self.starts, lo = part(lo, self.n_docs + 1, "<u8")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file; reads the blocks that hold them."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        raw = self._read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        base, out = int(self.offsets[first]), []
        if self.block * self.bits % 8 == 0:
            out = [unpack_bits(raw, min(self.n_ids, (last + 1) * self.block) - first * self.block, self.bits)]
        else:
            for k in range(first, last + 1):
                a, z = int(self.offsets[k]) - base, int(self.offsets[k + 1]) - base
                out.append(unpack_bits(raw[a:z], min(self.block, self.n_ids - k * self.block), self.bits))
        return np.concatenate(out)[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_files(path: str, tokenizer: str, end_id: int, block: int):
    run = uuid.uuid4().hex[:12]  # of this call, the same for all attempts of a task

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        where, folder = fs.FileSystem.from_uri(path)
        where.create_dir(folder, recursive=True)
        name, draft = f"part-{part:06d}-{run}.ids", f".{part:06d}-{uuid.uuid4().hex}"
        writer = None
        with where.open_output_stream(f"{folder}/{draft}") as out:
            writer = TokenFileWriter(out, bits_for(enc.vocab_size), block)
            for b in batches:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    writer.add(doc_id, enc.ids(text or "") + end)
            done = writer.close()
        if not done["n_docs"]:
            where.delete_file(f"{folder}/{draft}")
            return
        if where.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
            where.move(f"{folder}/{draft}", f"{folder}/{name}")
        else:  # another attempt of this task has written the same file
            where.delete_file(f"{folder}/{draft}")
        yield batch(FILES, {k: [v] for k, v in (done | {"file": f"{path}/{name}", "part": part}).items()})

    return write


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, first): each document's place and checksum, ranges of about a million ids at a time."""
    for b in batches:
        for name, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist()):
            where, path = fs.FileSystem.from_uri(name)
            with where.open_input_file(path) as file:
                f = TokenFile(file)
                k = 0
                while k < f.n_docs:
                    end = max(k + 1, int(np.searchsorted(f.starts, f.starts[k] + 1_000_000)) - 1)
                    end = min(end, f.n_docs)
                    lo = int(f.starts[k])
                    raw = memoryview(f.ids(lo, int(f.starts[end])).astype("<u4").tobytes())
                    cuts = ((f.starts[k : end + 1].astype(np.int64) - lo) * 4).tolist()
                    crc = [zlib.crc32(raw[a:z]) for a, z in zip(cuts, cuts[1:])]
                    ids = [None if null else i for i, null in zip(f.doc_ids[k:end].tolist(), f.nulls[k:end].tolist())]
                    yield batch(DOCS, {"doc_id": ids, "start": (f.starts[k:end].astype(np.int64) + first), "n_tokens": np.diff(f.starts[k : end + 1].astype(np.int64)), "ids_crc32": crc})
                    k = end


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Write the files under ``path``; one row per file with ``first``, the ids of all files before it."""
    rows = text_rows(df, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(ordered.mapInArrow(write_files(path, tokenizer, end_id, block), FILES_DDL), "token_files")
    # One row per file, so this window is as small as the list of files.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    return files.select("file", "first").repartition("file").mapInArrow(read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write, then read back."""
    return read_token_files(write_token_files(df, path or new_path(df.sparkSession, "ids"), **options))
