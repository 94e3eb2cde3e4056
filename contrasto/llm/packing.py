"""Packing documents into fixed-length sequences: bounded-space online packing.

A task keeps a fixed number of open windows.  A piece goes to the open window with the least room that fits it
(best fit).  When none fits and no further window may be opened, the fullest window is filled from the piece and
emitted; the rest is placed anew.  Documents longer than a window give whole windows first.  So emitted windows
are full.  What a task leaves open is merged by further rounds of the same packing over groups of tasks, until
one group is left; its last tokens form sequences whose lengths are powers of two, which need no padding.

Defined cases: null text is empty (its end id alone); an empty table gives no pieces; repeated rows are packed
each for itself; of windows with equal room the first opened is taken; the ids of a very long text take four bytes each in its
task, and it gives whole windows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import batch, materialize, text_rows
from contrasto.llm.tokens import END_ID, TOKENIZER, encoder

WINDOW = 4096
OPEN_WINDOWS = 16
#: Tasks whose leftovers one merging task takes.
MERGE = 16

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Pieces are (doc_id, start, doc_tokens, ids as bytes of 4 each)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.most, self.next = window, open_windows, first_sequence
        self.open: list[list] = []  # [tokens so far, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at, None))
            at += n
        self.next += 1

    def add(self, doc_id, start: int, total: int, ids: bytes) -> None:
        w, at, n = self.window, 0, len(ids) // 4
        while n - at >= w:
            self.emit([(doc_id, start + at, total, ids[4 * at : 4 * (at + w)])])
            at += w
        while at < n:
            best = fullest = None
            for x in self.open:
                if x[0] + n - at <= w and (best is None or x[0] > best[0]):
                    best = x
                if fullest is None or x[0] > fullest[0]:
                    fullest = x
            if best is None and len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            into = best or fullest
            take = min(n - at, w - into[0])
            into[1].append((doc_id, start + at, total, ids[4 * at : 4 * (at + take)]))
            into[0] += take
            at += take
            if into[0] == w:
                self.emit(into[1])
                self.open.remove(into)

    def leftovers(self) -> list[tuple]:
        """The pieces of the open windows, with their ids, for the next round."""
        left = [(d, s, len(ids) // 4, None, total, None, None, ids) for _, pieces in self.open for d, s, total, ids in pieces]
        self.open = []
        return left

    def finish(self) -> None:
        """The last round: what is open is filled up from each other; the end goes into powers of two."""
        pieces = [p for _, ps in sorted(self.open, key=lambda x: -x[0]) for p in ps]
        self.open = []
        left = sum(len(p[3]) // 4 for p in pieces)
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            left -= size
            into = []
            while size:
                d, s, total, ids = pieces.pop(0)
                n = len(ids) // 4
                if n > size:
                    pieces.insert(0, (d, s + size, total, ids[4 * size :]))
                    ids, n = ids[: 4 * size], size
                into.append((d, s, total, ids))
                size -= n
            self.emit(into)


def _taken(packer: Packer) -> list[tuple]:
    rows, packer.rows = packer.rows, []
    return rows


def _block(rows: list[tuple]) -> pa.RecordBatch:
    return batch(PIECES, dict(zip(PIECES.names, map(list, zip(*rows)))))


def pack_partition(tokenizer: str, end_id: int, window: int, open_windows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 28, window, open_windows)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text or "") + end
                packer.add(doc_id, 0, len(ids) // 4, ids)
            if len(packer.rows) >= 2048:
                yield _block(_taken(packer))
        if rows := _taken(packer) + packer.leftovers():
            yield _block(rows)

    return pack


def merge_group(level: int, last: bool, window: int, open_windows: int):
    def merge(table: pa.Table) -> pa.Table:
        group = table.column("part")[0].as_py()
        packer = Packer((level << 56) | (group << 28), window, open_windows)
        rows = table.select(["doc_id", "start", "length", "doc_tokens", "ids"]).to_pylist()
        for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["length"])):
            packer.add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
        if last:
            packer.finish()
        out = _block(_taken(packer) + packer.leftovers())
        return pa.table([pa.array([group] * out.num_rows, pa.int64()), *out.columns], names=["part", *PIECES.names])

    return merge


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Cutting ``ids[start:start + length]`` of each piece's document and placing it at ``offset`` gives the sequences.
    """
    rows = text_rows(df, id_col, text_col)
    parts = rows.mapInArrow(pack_partition(tokenizer, end_id, window, open_windows), PIECES_DDL)
    first = materialize(parts.select(F.spark_partition_id().cast("long").alias("part"), *PIECES.names), "packing")
    done, left = [first.where("ids is null").select(*OUT)], first.where("ids is not null")
    groups, level = (left.agg(F.max("part")).first()[0] or 0) + 1, 0
    while True:
        groups, level = -(-groups // MERGE), level + 1
        merged = left.withColumn("part", F.floor(F.col("part") / MERGE)).groupBy("part").applyInArrow(merge_group(level, groups <= 1, window, open_windows), f"part long, {PIECES_DDL}")
        if groups <= 1:
            done.append(merged.select(*OUT))
            break
        merged = materialize(merged, "packing")
        done.append(merged.where("ids is null").select(*OUT))
        left = merged.where("ids is not null")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
