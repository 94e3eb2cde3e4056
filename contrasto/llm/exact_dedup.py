"""Exact deduplication by Grace hashing.

Texts are equal when identical after each run of ASCII white space became one space.  Three steps:

1. Each input task puts its records into an open-addressing table that compares complete content, and sends on
   one record of each distinct text.  However many copies a text has, a task sends one (one per flush, when
   the table outgrows its memory), so no bucket receives a hot group.
2. These are partitioned by content hash (Spark's shuffle files are the first level of partitioning).  A bucket's
   task fills an open-addressing table; once it is full, records that it doesn't hold go to spill files by
   further hash bits, and each file is processed the same way, recursively.
3. The other copies look up the decision of the record that stood for them.

Defined cases: null text equals empty text; of equal texts the smallest doc_id stays, a null doc_id only when
there is no other; of repeated rows (same doc_id and text) exactly one has ``kept``; a very long text is one record, held
whole by the tasks that compare it, and a table with one record may outgrow its bound; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tempfile
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import batch, materialize, raw_texts, text_rows

#: Bytes of distinct content a table may hold before a task flushes (step 1) or spills (step 2).
TABLE_BYTES = 48 << 20
FAN_OUT = 16
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUN = re.compile(rb"  +")
_ROW = struct.Struct("<qqqqB")
_LAST = (1 << 63) - 1


def normalize(raw: bytes) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space."""
    raw = raw.translate(_SPACES)
    return _RUN.sub(b" ", raw) if b"  " in raw else raw


class OpenTable:
    """Open addressing with linear probing; an entry matches only if its complete content does."""

    def __init__(self, bits: int = 10):
        self.mask = (1 << bits) - 1
        self.slots = array("q", [-1]) * (1 << bits)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(entry or -1, slot where the search ended)."""
        at = h & self.mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, at
            at = (at + 1) & self.mask
        return -1, at

    def add(self, h: int, content: bytes, at: int) -> int:
        e = len(self.hashes)
        self.slots[at] = e
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 120
        if 2 * len(self.hashes) > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = array("q", [-1]) * (self.mask + 1)
            for i, x in enumerate(self.hashes):
                at = x & self.mask
                while self.slots[at] >= 0:
                    at = (at + 1) & self.mask
                self.slots[at] = i
        return e


REPS = pa.schema([("route", pa.int64()), ("rep_key", pa.int64()), ("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hash", pa.int64()), ("content", pa.binary())])
REPS_DDL = "route long, rep_key long, row_key long, doc_id long, n long, hash long, content binary"
DECIDED = pa.schema([("rep_key", pa.int64()), ("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("is_rep", pa.bool_()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("text_sha256", pa.string())])
DECIDED_DDL = "rep_key long, row_key long, doc_id long, n long, is_rep boolean, keep_id long, group_size long, kept boolean, text_sha256 string"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def local_representatives(batches: Iterator[pa.RecordBatch], table_bytes: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Step 1.  Of each distinct text of the task its row with the smallest doc_id, with content and count; the others without."""
    task = TaskContext.get()
    seq = (task.partitionId() if task else 0) << 36
    rows = {f.name: [] for f in REPS}

    def emit(route, rep_key, row_key, doc_id, n, h, content):
        for k, v in zip(rows, (route, rep_key, row_key, doc_id, n, h, content)):
            rows[k].append(v)

    def flush(table, best, counts):
        nonlocal seq, rows
        size = 0
        for e, (doc_id, row_key, key) in enumerate(best):
            h = _signed(table.hashes[e])
            emit(h, key, row_key, doc_id, counts[e], h, table.contents[e])
            size += len(table.contents[e])
            if size > 4 << 20:
                yield batch(REPS, rows)
                rows, size = {f.name: [] for f in REPS}, 0
        if rows["route"]:
            yield batch(REPS, rows)
            rows = {f.name: [] for f in REPS}

    table, best, counts = OpenTable(), [], []
    for b in batches:
        for doc_id, row_key, raw in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), raw_texts(b.column("text"))):
            content = normalize(raw)
            h = xxhash.xxh3_64_intdigest(content)
            e, at = table.find(h, content)
            if e < 0:
                table.add(h, content, at)
                best.append((doc_id, row_key, seq))
                counts.append(1)
                seq += 1
                continue
            counts[e] += 1
            was_id, was_row, key = best[e]
            if (_LAST if doc_id is None else doc_id) < (_LAST if was_id is None else was_id):
                best[e] = (doc_id, row_key, key)
                doc_id, row_key = was_id, was_row
            emit(_signed(xxhash.xxh3_64_intdigest(b"%d" % row_key)), key, row_key, doc_id, None, None, None)
        if table.bytes > table_bytes:
            yield from flush(table, best, counts)
            table, best, counts = OpenTable(), [], []
    yield from flush(table, best, counts)


def _spilled(file) -> Iterator[tuple]:
    file.seek(0)
    while head := file.read(_ROW.size + 8):
        *row, has_id = _ROW.unpack(head[: _ROW.size])
        yield row[0], row[1], row[2] if has_id else None, row[3], *struct.unpack("<q", head[_ROW.size :]), file.read(struct.unpack("<q", file.read(8))[0])


class Grace:
    """Step 2 for one bucket.  Rows: (rep_key, row_key, doc_id, n, hash, content)."""

    def __init__(self, table_bytes: int = TABLE_BYTES, level: int = 0):
        self.table, self.groups, self.files = OpenTable(), [], {}
        self.table_bytes, self.level = table_bytes, level

    def add(self, row: tuple) -> None:
        rep_key, row_key, doc_id, n, h, content = row
        e, at = self.table.find(h & ((1 << 64) - 1), content)
        if e < 0 and self.table.bytes > self.table_bytes:
            part = xxhash.xxh64_intdigest(content, seed=self.level) % FAN_OUT
            f = self.files.get(part)
            if f is None:
                f = self.files[part] = tempfile.TemporaryFile(buffering=1 << 18)
            f.write(_ROW.pack(rep_key, row_key, doc_id or 0, n, doc_id is not None) + struct.pack("<qq", h, len(content)) + content)
            return
        if e < 0:
            self.table.add(h & ((1 << 64) - 1), content, at)
            self.groups.append([])
        self.groups[e].append((rep_key, row_key, doc_id, n))

    def finish(self) -> Iterator[tuple]:
        """(rep_key, row_key, doc_id, n, keep_id, group_size, kept, sha256) of each row added."""
        for members, content in zip(self.groups, self.table.contents):
            sha = hashlib.sha256(content).hexdigest()
            win = min(members, key=lambda m: (m[2] is None, m[2] or 0, m[1]))
            size = sum(m[3] for m in members)
            for m in members:
                yield (*m, win[2], size, m is win, sha)
        self.table, self.groups = OpenTable(), []
        for f in self.files.values():
            with f:
                below = Grace(self.table_bytes, self.level + 1)
                for row in _spilled(f):
                    below.add(row)
            yield from below.finish()


def decide_buckets(batches: Iterator[pa.RecordBatch], table_bytes: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Step 2 over a bucket; the rows without content pass through to step 3."""
    block = lambda rows: batch(DECIDED, dict(zip(DECIDED.names, map(list, zip(*rows)))))
    bucket = Grace(table_bytes)
    for b in batches:
        passed = []
        for row in zip(*(b.column(k).to_pylist() for k in ("rep_key", "row_key", "doc_id", "n", "hash", "content"))):
            if row[3] is None:
                passed.append((*row[:3], None, False, None, None, False, None))
            else:
                bucket.add(row)
        if passed:
            yield block(passed)
    rows = ((*r[:4], True, *r[4:]) for r in bucket.finish())
    while out := list(islice(rows, 4096)):
        yield block(out)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256 (and row_key, from ``row_col`` where given).

    ``row_col`` names a unique long column; without it rows are told apart by a generated one.
    """
    key = (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_key")
    rows = text_rows(df, id_col, text_col, key)
    reps = rows.mapInArrow(local_representatives, REPS_DDL)
    decided = materialize(reps.repartition("route").mapInArrow(decide_buckets, DECIDED_DDL), "exact_dedup")
    out = ["row_key", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    stood = decided.where("is_rep and n > 1").select("rep_key", "keep_id", "group_size", "text_sha256")
    others = decided.where("not is_rep").select("rep_key", "row_key", "doc_id", "kept").join(stood, "rep_key")
    both = decided.where("is_rep").select(*out).unionByName(others.select(*out))
    return both if row_col else both.drop("row_key")
