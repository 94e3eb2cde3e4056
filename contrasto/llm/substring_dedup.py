"""Removal of repeated substrings by blockwise suffix sorting.

A string of ``LENGTH`` bytes that starts at two places has the same least hash among its 64-byte grams at both, at the
same offset (the leftmost one counts).  So the places are dealt by that gram: equal strings always meet.

1. Each task finds, for every text, the runs of neighbouring places with the same leftmost least gram; the runs of one
   gram within a text travel as one row, and once a task for repeated rows.
2. Only runs whose gram occurs in another run can hold a repeat; the others are dropped by a semi-join.
3. The strings of the remaining runs are cut from the texts.  A task sends at most two copies of a string, for
   further copies can't change a decision; so a passage shared by very many documents stays small.  Runs of grams
   that occur very often are dealt again by the bytes common to sixteen neighbouring places, which leaves few strings in one group.
4. A task takes its groups in order, a block of bounded size at a time, sorts the block's suffixes
   (difference cover, see suffix_array.py) and marks the places whose neighbours in the order agree for LENGTH bytes.
5. Marks go back to the documents, and the covered bytes are removed.

Rows with the same id and text are one text in steps 2 to 5; each of them has all its strings in the others, so all of
a text of LENGTH bytes or more that stands in several such rows is removed.  The work grows with the number of such rows, not its square.

Defined cases: null text is empty; texts shorter than LENGTH keep everything; repeated rows count as further places (each
loses all its bytes if it has LENGTH of them); very long texts are read in pieces of PIECE places, and a task's memory is a few times
its longest text; equal strings need no order among them, so there are no ties; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import batch, materialize, new_path, raw_texts, text_rows
from contrasto.llm.suffix_array import repeated

LENGTH = 400
GRAM = 64
#: Places handled at a time within one text.
PIECE = 1 << 19
#: Runs of one gram from which on they are dealt again, and the places of a run then.
HOT, HOT_PLACES = 500, 16
BLOCK_BYTES = 2 << 20
#: Strings and texts that a task remembers having sent; beyond it some are sent again, which changes nothing.
REMEMBERED = 300_000
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 20) - 1)

FOUND = pa.schema([("kind", pa.int32()), ("did", pa.int64()), ("th", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("key", pa.int64()), ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
FOUND_DDL = "kind int, did long, th long, n_bytes long, sha string, key long, starts array<long>, counts array<int>"
CUT = pa.schema([("kind", pa.int32()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("key", pa.int64()), ("shash", pa.int64()), ("content", pa.binary())])
CUT_DDL = "kind int, did long, th long, start long, key long, shash long, content binary"
MARKS = pa.schema([("key", pa.int64()), ("shash", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])
MARKS_DDL = "key long, shash long, lo array<int>, hi array<int>"
DONE = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
DONE_DDL = "did long, th long, n_removed long, n_spans long, kept_sha256 string"


def gram_runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, places) of the runs of places with the same leftmost least gram."""
    keys, starts, counts = [], [], []
    places = len(raw) - length + 1
    for lo in range(0, max(places, 0), PIECE):
        part = np.frombuffer(raw, np.uint8, min(PIECE, places - lo) + length - 1, lo)
        h, m, power = part.astype(np.uint64), 1, _BASE
        while m < gram:  # gram is a power of two
            h = h[:-m] * np.uint64(power) + h[m:]
            m, power = 2 * m, power * power & ((1 << 64) - 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        x, wide, want = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
        while 2 * wide <= want:
            x = np.minimum(x[:-wide], x[wide:])
            wide *= 2
        if wide < want:
            x = np.minimum(x[: len(x) - (want - wide)], x[want - wide :])
        at = (x & _LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        keys.append(h[at[first]].view(np.int64))
        starts.append(first + lo)
        counts.append(np.diff(np.append(first, len(at))))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


def find_runs(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            did, th, docs, runs = b.column("did").to_pylist(), b.column("th").to_pylist(), [], []
            for k, raw in enumerate(raw_texts(b.column("text"))):
                docs.append((len(raw), hashlib.sha256(raw).hexdigest()))
                if len(raw) >= length and (did[k], th[k]) not in seen:
                    seen.add((did[k], th[k]))
                    runs.append((k, *gram_runs(raw, length)))
            if len(seen) > REMEMBERED:
                seen.clear()
            n = len(docs)
            none = [None] * n
            yield batch(FOUND, {"kind": [0] * n, "did": did, "th": th, "n_bytes": [d[0] for d in docs], "sha": [d[1] for d in docs], "key": none, "starts": none, "counts": none})
            if runs:
                which, key, start, count = np.repeat([r[0] for r in runs], [len(r[1]) for r in runs]), *(np.concatenate([r[c] for r in runs]) for c in (1, 2, 3))
                order = np.lexsort((start, key, which))
                which, key, start, count = which[order], key[order], start[order], count[order]
                first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])))
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(x.astype(kind)))
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(n, np.int32)), pa.array(np.array(did)[which[first]]), pa.array(np.array(th)[which[first]]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(key[first]), lists(start, np.int64), lists(count, np.int32)],
                    schema=FOUND,
                )

    return find


def cut_strings(length: int):
    """Rows (did, th, text, runs) to kind 0: the text, 1: places of strings, 2: the strings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        seen: set[tuple[int, int]] = set()
        digest = xxhash.xxh3_64_intdigest
        sign = lambda h: h - (1 << 64) if h >> 63 else h
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for did, th, raw, runs in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), raw_texts(b.column("text")), b.column("runs")):
                if (did, th) in seen:
                    continue
                seen.add((did, th))
                rows.append((0, did, th, None, None, None, raw))
                size += len(raw)
                pieces = []
                for r, start, n in ((r, *x) for r in runs.as_py() for x in zip(r["starts"], r["counts"])):
                    key = r["key"]
                    if not r["hot"]:
                        pieces.append((key, start, n))
                        continue
                    # the places by their distance to the end of the run's gram, so that equal places fall together
                    anchor = start + int(_leftmost(raw[start : start + length]))
                    s = start
                    while s < start + n:
                        e = min(start + n, anchor - (anchor - s) // HOT_PLACES * HOT_PLACES + 1)
                        g = (anchor - s) // HOT_PLACES * HOT_PLACES
                        # all places of the group hold the bytes from its last place on, up to the end of its first
                        core = raw[anchor - g : anchor - g - HOT_PLACES + 1 + length]
                        pieces.append((sign(digest(core, seed=g + 1)), s, e - s))
                        s = e
                for key, start, n in pieces:
                    text = raw[start : start + n + length - 1]
                    h = sign(digest(text))
                    rows.append((1, did, th, start, key, h, None))
                    before = sent.get((key, h), 0)
                    if before < 2:
                        sent[key, h] = before + 1
                        rows.append((2, None, None, None, key, h, text))
                        size += len(text)
                    size += 64
                if len(sent) > REMEMBERED:
                    sent.clear()
                if len(seen) > REMEMBERED:
                    seen.clear()
                if size > 8 << 20:
                    yield batch(CUT, dict(zip(CUT.names, map(list, zip(*rows)))))
                    rows, size = [], 0
        if rows:
            yield batch(CUT, dict(zip(CUT.names, map(list, zip(*rows)))))

    return cut


def _leftmost(window: bytes) -> int:
    """Where in a string of LENGTH bytes the leftmost least gram starts."""
    part = np.frombuffer(window, np.uint8)
    h, m, power = part.astype(np.uint64), 1, _BASE
    while m < GRAM:
        h = h[:-m] * np.uint64(power) + h[m:]
        m, power = 2 * m, power * power & ((1 << 64) - 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return int((h & ~_LOW).argmin())


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), edge[1::2].tolist()


def mark_blocks(length: int, block_bytes: int = BLOCK_BYTES):
    """Strings sorted by key to their repeated places, a block of whole keys at a time."""

    def decide(strings: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        flags = repeated([s for _, _, s in strings], length)
        seen: dict[tuple[int, int], tuple] = {}
        for (key, h, _), f in zip(strings, flags):
            if f.any() and (key, h) not in seen:
                seen[key, h] = _ranges(f)
        if not seen:
            return None
        return batch(MARKS, {"key": [k for k, _ in seen], "shash": [h for _, h in seen], "lo": [v[0] for v in seen.values()], "hi": [v[1] for v in seen.values()]})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, bytes]] = []
        own: list[tuple[int, int, bytes]] = []  # of the current key
        size = 0
        for b in batches:
            for key, h, text in zip(b.column("key").to_pylist(), b.column("shash").to_pylist(), b.column("content").to_pylist()):
                if own and own[-1][0] != key:
                    if len(own) > 1:  # a string alone can only repeat within itself, and then its gram has further runs
                        block += own
                        size += sum(len(x[2]) for x in own)
                    own = []
                    if size > block_bytes:
                        if (out := decide(block)) is not None:
                            yield out
                        block, size = [], 0
                if len(own) > 1 and own[-1][1] == h and own[-2][1] == h:
                    continue  # a third copy
                own.append((key, h, text))
        if len(own) > 1:
            block += own
        if block and (out := decide(block)) is not None:
            yield out

    return mark


def remove(length: int):
    """Rows (did, th, content, marks) to what is removed of each text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for did, th, raw, marks in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("content").to_pylist(), b.column("marks").to_pylist()):
                edge = np.zeros(len(raw) + 1, np.int64)
                for m in marks:
                    lo, hi = np.array(m["lo"]) + m["start"], np.array(m["hi"]) + m["start"] + length - 1
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((did, th, int(gone.sum()), len(_ranges(gone)[0]), hashlib.sha256(kept).hexdigest()))
            if out:
                yield batch(DONE, dict(zip(DONE.names, map(list, zip(*out)))))

    return apply


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.  ``length`` is 400 here (385 to 402 work)."""
    rows = text_rows(df, id_col, text_col).selectExpr(f"coalesce(doc_id, {-(1 << 63) + 1}L) AS did", "xxhash64(text) AS th", "text")
    found = _written(rows.mapInArrow(find_runs(length), FOUND_DDL), "substring")
    runs = found.where("kind = 1").select("did", "th", "key", "starts", "counts")
    often = runs.groupBy("key").agg(F.sum(F.size("starts")).alias("c")).where("c > 1").select("key", (F.col("c") > HOT).alias("hot"))
    # written, so that both sides of the join have exchanges of their own and a frequent gram's rows can be split
    often = materialize(often, "substring")
    wanted = runs.join(often, "key").groupBy("did", "th").agg(F.collect_set(F.struct("key", "starts", "counts", "hot")).alias("runs"))
    cut = _written(rows.join(wanted, ["did", "th"]).mapInArrow(cut_strings(length), CUT_DDL), "substring")
    strings = cut.where("kind = 2").select("key", "shash", "content")
    marks = strings.repartition("key").sortWithinPartitions("key", "shash").mapInArrow(mark_blocks(length), MARKS_DDL)
    places = cut.where("kind = 1").select("did", "th", "start", "key", "shash")
    marked = places.join(marks, ["key", "shash"]).groupBy("did", "th").agg(F.collect_set(F.struct("start", "lo", "hi")).alias("marks"))
    texts = cut.where("kind = 0").select("did", "th", "content")
    done = texts.join(marked, ["did", "th"]).mapInArrow(remove(length), DONE_DDL).dropDuplicates(["did", "th"])
    docs = found.where("kind = 0").select("did", "th", "n_bytes", "sha")
    several = materialize(docs.where(F.col("n_bytes") >= length).groupBy("did", "th").agg(F.count("*").alias("c")).where("c > 1").select("did", "th", F.lit(True).alias("whole")), "substring")
    out = docs.join(done, ["did", "th"], "left").join(several, ["did", "th"], "left")
    return out.selectExpr(
        f"nullif(did, {-(1 << 63) + 1}L) AS doc_id", "n_bytes", "if(whole, n_bytes, coalesce(n_removed, 0L)) AS n_removed", "if(whole, 1L, coalesce(n_spans, 0L)) AS n_spans",
        f"if(whole, '{hashlib.sha256(b'').hexdigest()}', coalesce(kept_sha256, sha)) AS kept_sha256",
    )
