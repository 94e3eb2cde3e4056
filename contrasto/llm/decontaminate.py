"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared as letters and digits in lower case, everything else as one space (UTF-8 bytes are the
characters).  An item of m characters occurring with at most e edits shares at least m + 1 - q (e + 1) of its q-grams
with the text, on diagonals that differ by at most e.  So q-gram hits are counted in diagonal bands of width
2 (e + 1) that overlap by half; bands that reach the bound are verified by an alignment in the band, and kept when its
edit distance is within the budget.

The benchmark is written to the shared folder in blocks of bounded size.  Documents are scanned once whatever its size: a
task reads the blocks in turn for each 16 MB of its texts, after one bitmap of the q-grams of all blocks has dropped the
places that match none.  Hits are counted in slices of bounded size; a q-gram that occurs very often on both sides (texts of one letter)
is counted per band from its sorted places, without making every pair of places.  Texts over ``CHUNK`` bytes are read in
pieces that overlap by more than the longest stretch an item can match.

Defined cases: null and empty texts and items match nothing; an item whose q-grams can't bear the budget gets the
largest budget for which the bound is at least one; items shorter than q match exactly, as whole words; equal items each match;
of several matches of an item in a text the one with the least edits counts, then the first; repeated rows each give rows;
very long texts and texts of few different letters need no more memory than others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import batch, new_path, small_batches, text_rows

Q = 8
#: Edits allowed per character of an item.
ERROR_RATE = 0.1
#: Bytes of benchmark text in one block (its index takes about 30 times that).
BLOCK_BYTES = 2 << 20
#: Blocks whose indexes a worker keeps.
BLOCKS_KEPT = 2
#: Normalised bytes of text looked up at a time, and of texts for which a block is read.
CHUNK, GROUP = 1 << 21, 1 << 24
#: Pairs of places counted at a time; a q-gram with more than DENSE of them, its places close together, is counted per band.
SLICE, DENSE = 1 << 20, 1 << 18
#: Cells of the bands aligned at a time.
CELLS = 1 << 18
_BITMAP_LOG2 = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_RUN = re.compile(rb"  +")
MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_chars", pa.int32()), ("match_end", pa.int64())])
MATCHES_DDL = "doc_id long, item_id long, edits int, item_chars int, match_end long"


def normalize(text: str | None) -> bytes:
    text = text or ""
    raw = (text if text.isascii() else text.lower()).encode("utf-8", "surrogatepass").translate(_TABLE)
    return _RUN.sub(b" ", raw).strip(b" ")


def budget(m: int, q: int = Q, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item of m characters."""
    return max(0, min(int(m * rate), (m + 1 - 1) // q - 1))


def grams(raw: bytes, q: int = Q) -> np.ndarray:
    """The q bytes at each position, as one integer."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.ndarray(n, "<u8", raw + bytes(8), strides=(1,))
    return g & np.uint64((1 << (8 * q)) - 1) if q < 8 else g


def spot(gram: np.ndarray) -> np.ndarray:
    return (gram * _MULT) >> np.uint64(64 - _BITMAP_LOG2)


class QGramIndex:
    """The q-grams of a block of items.  Their first eight bytes are the key, so q is at most 8."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, rate: float = ERROR_RATE):
        self.q = q
        pairs = [(i, normalize(t)) for i, t in items]
        self.short = [(i, t) for i, t in pairs if 0 < len(t) < q]
        pairs = [(i, t) for i, t in pairs if len(t) >= q]
        self.ids = [i for i, _ in pairs]
        self.items = [np.frombuffer(t, np.uint8) for _, t in pairs]
        m = np.array([len(t) for _, t in pairs], np.int64)
        self.m = m
        self.e = np.array([budget(int(x), q, rate) for x in m], np.int64)
        self.need = m + 1 - q * (self.e + 1)
        self.width = self.e + 1
        self.gap = int(self.e.max(initial=0)) + q + 1
        self.longest = int((m + 2 * self.e).max(initial=0)) + q
        own = [grams(t.tobytes(), q) for t in self.items]
        gram = np.concatenate(own) if own else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(pairs)), [len(g) for g in own])
        pos = np.concatenate([np.arange(len(g)) for g in own]) if own else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << _BITMAP_LOG2, bool)
        self.bitmap[spot(self.gram)] = True

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(index of text, item id, edits, characters of the item, end in the normalised text): the best of each text and item."""
        return search([self], self.bitmap, texts)

    def short_items(self, raws: list[tuple[int, bytes]], best: dict) -> None:
        for i, item in self.short:
            for k, raw in raws:
                if (at := (b" " + raw + b" ").find(b" " + item + b" ")) >= 0:
                    value = (0, len(item), at + len(item))
                    best[k, i] = min(value, best.get((k, i), value))

    def match(self, chunk: Chunk, best: dict) -> None:
        """Bands of a chunk that reach the bound, and their alignments."""
        if not len(self.gram):
            return
        found = np.searchsorted(self.gram, chunk.gram)
        found[found == len(self.gram)] = 0
        good = self.gram[found] == chunk.gram
        key, votes = self.votes(chunk.at[good], found[good])
        # a band and the next one: half-overlapping bands of twice the width
        after = np.searchsorted(key, key + 1)
        after[after == len(key)] = 0
        pair = votes + np.where(key[after] == key + 1, votes[after], 0)
        before = np.searchsorted(key, key - 1)
        before[before == len(key)] = 0
        alone = (key[before] != key - 1) & (votes >= self.need[key >> 34])
        where = np.unique(np.concatenate([key[pair >= self.need[key >> 34]], key[alone] - 1]))
        item = where >> 34
        lo = (where & ((1 << 34) - 1)) * self.width[item] - (1 << 30) - self.e[item]
        order = np.argsort(self.m[item], kind="stable")
        at = 0
        while at < len(order):
            # as many bands as fit a bounded number of cells
            some = order[at : at + 64]
            some = order[at : at + max(64, CELLS // int(2 * (self.width + self.e)[item[some]].max() + self.m[item[some]].max()))]
            at += len(some)
            who = item[some]
            edits, end = banded([self.items[i] for i in who], chunk.text, lo[some], int((2 * self.width[who] + 2 * self.e[who]).max()))
            part = np.searchsorted(chunk.starts, end - 1, side="right") - 1
            for j in np.flatnonzero(edits <= self.e[who]).tolist():
                i, d = int(who[j]), int(part[j])
                spot, value = (chunk.owner[d], self.ids[i]), (int(edits[j]), int(self.m[i]), int(end[j] - chunk.starts[d]) + chunk.base[d])
                if spot not in best or value < best[spot]:
                    best[spot] = value

    def votes(self, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits of the text's places ``at`` with the index's q-grams ``found``, counted by item and band: (item << 34 | band, count), sorted."""
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def add(key, count):
            key, back = np.unique(key, return_inverse=True)
            keys.append(key)
            counts.append(np.bincount(back, weights=count, minlength=len(key)).astype(np.int64))
            if sum(map(len, keys)) > SLICE:
                fold()

        def fold():
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
            keys[:], counts[:] = [key], [n]

        hits = np.bincount(found, minlength=len(self.gram))
        dense = hits * self.count > DENSE
        if dense.any():
            for g in np.flatnonzero(dense).tolist():
                places = at[found == g]
                if (places[-1] - places[0]) > 8 * len(places):
                    dense[g] = False
                    continue
                for line in range(int(self.first[g]), int(self.first[g] + self.count[g])):
                    i, p = int(self.item[line]), int(self.pos[line])
                    w = int(self.width[i])
                    lo, hi = (int(places[0]) - p + (1 << 30)) // w, (int(places[-1]) - p + (1 << 30)) // w
                    if hi - lo < len(places):
                        n = np.diff(np.searchsorted(places, np.arange(lo, hi + 2) * w - (1 << 30) + p))
                        some = np.flatnonzero(n)
                        keys.append((i << 34) | (lo + some))
                        counts.append(n[some])
                    else:
                        add((i << 34) | ((places - p + (1 << 30)) // w), np.ones(len(places)))
                    if sum(map(len, keys)) > SLICE:
                        fold()
            thin = ~dense[found]
            at, found = at[thin], found[thin]
        n = self.count[found]
        total = np.cumsum(n)
        a = 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE, side="right")))
            m = n[a:z]
            # every hit with every place of its q-gram in the items
            line = np.repeat(self.first[found[a:z]], m) + (np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m))
            item = self.item[line]
            add((item << 34) | ((np.repeat(at[a:z], m) - self.pos[line] + (1 << 30)) // self.width[item]), np.ones(len(line)))
            a = z
        fold()
        return keys[0], counts[0]


class Chunk:
    """Pieces of texts, joined with gaps that nothing matches, and the places whose q-grams may be the benchmark's."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], q: int, gap: int, bitmap: np.ndarray):
        """pieces: (index of text, where in it the piece begins, bytes)."""
        self.owner, self.base = [p[0] for p in pieces], [p[1] for p in pieces]
        fill = b"\xff" * gap
        joined = fill + fill.join(p[2] for p in pieces) + fill
        self.starts = np.cumsum([gap] + [len(p[2]) + gap for p in pieces[:-1]])
        self.text = np.frombuffer(joined, np.uint8)
        gram = grams(joined, q)
        self.at = np.flatnonzero(bitmap[spot(gram)])
        self.gram = gram[self.at]


def search(blocks, bitmap: np.ndarray, texts: list[str | None], longest: int = 0, gap: int = 0, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """What ``QGramIndex.find`` returns, over several blocks (an iterable that can be read again and again)."""
    best: dict[tuple[int, int], tuple] = {}
    if isinstance(blocks, list):
        longest, gap, q = (max((f(b) for b in blocks), default=0) for f in (lambda b: b.longest, lambda b: b.gap, lambda b: b.q))
    chunks: list[Chunk] = []
    raws: list[tuple[int, bytes]] = []
    pieces, size, total = [], 0, 0

    def run():
        for block in blocks:
            block.short_items(raws, best)
            for c in chunks:
                block.match(c, best)
        raws.clear()
        chunks.clear()

    for k, text in enumerate(texts):
        raw = normalize(text)
        raws.append((k, raw))
        for a in range(0, max(len(raw), 1), CHUNK):
            # a piece and as much of what follows as a match that begins in it can take
            piece = raw[a : a + CHUNK + longest]
            pieces.append((k, a, piece))
            size += len(piece)
            if size > CHUNK:
                chunks.append(Chunk(pieces, q, gap, bitmap))
                total, pieces, size = total + size, [], 0
            if total > GROUP:
                run()
                total = 0
    if pieces:
        chunks.append(Chunk(pieces, q, gap, bitmap))
    if chunks or raws:
        run()
    return [(k, i, *v) for (k, i), v in best.items()]


def banded(items: list[np.ndarray], text: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item the least edits of the whole of it against any stretch of the text on the diagonals from its lo on, and that stretch's end."""
    n, m = len(items), np.array([len(x) for x in items])
    most = int(m.max())
    rows = np.zeros((n, most), np.uint8)
    for k, x in enumerate(items):
        rows[k, : len(x)] = x
    place = lo[:, None] + np.arange(width + most)
    part = np.where((place >= 0) & (place < len(text)), text[np.clip(place, 0, len(text) - 1)], 255).astype(np.uint8)
    kind = np.int16 if most + width < 1 << 14 else np.int32
    b = np.arange(width, dtype=kind)
    d = np.zeros((n, width), kind)
    edits, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(most):
        # same diagonal: match or change; next diagonal: the item's character is left out; previous: one is put in
        step = d + (part[:, i : i + width] != rows[:, i : i + 1])
        np.minimum(step[:, :-1], d[:, 1:] + 1, out=step[:, :-1])
        d = np.minimum.accumulate(step - b, axis=1) + b
        for k in np.flatnonzero(m == i + 1):
            at = int(d[k].argmin())
            edits[k], end[k] = d[k, at], lo[k] + at + i + 1
    return edits, end


class Benchmark:
    """A benchmark in the shared folder: blocks of bounded size, read by the tasks."""

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", q: int = Q, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES):
        items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.q, self.rate, self.n_blocks = q, rate, -(-size // block_bytes)
        self.path = new_path(benchmark.sparkSession, "benchmark")
        if self.n_blocks:
            block = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n_blocks)).alias("block")
            items.select(block, "item_id", "text").repartition("block").write.partitionBy("block").parquet(self.path)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """As ``QGramIndex.find``, over all blocks."""
        if not self.n_blocks:
            return []
        bitmap, longest, gap = _summary(self.path, self.n_blocks, self.q, self.rate)
        return search(self, bitmap, texts, longest, gap, self.q)

    def __iter__(self) -> Iterator[QGramIndex]:
        return (_block(self.path, k, self.q, self.rate) for k in range(self.n_blocks))


@lru_cache(BLOCKS_KEPT)
def _block(path: str, k: int, q: int, rate: float) -> QGramIndex:
    where, folder = fs.FileSystem.from_uri(path)
    if where.get_file_info(f"{folder}/block={k}").type == fs.FileType.NotFound:  # no item fell into it
        return QGramIndex([], q, rate)
    t = pq.read_table(f"{folder}/block={k}", filesystem=where, columns=["item_id", "text"], partitioning=None)
    return QGramIndex(list(zip(t.column("item_id").to_pylist(), t.column("text").to_pylist())), q, rate)


@lru_cache(1)
def _summary(path: str, n_blocks: int, q: int, rate: float) -> tuple[np.ndarray, int, int]:
    """One bitmap of the q-grams of all blocks, the longest stretch that an item can match, and the widest gap."""
    bitmap, longest, gap = np.zeros(1 << _BITMAP_LOG2, bool), 0, 0
    for k in range(n_blocks):
        b = _block(path, k, q, rate)
        bitmap |= b.bitmap
        longest, gap = max(longest, b.longest), max(gap, b.gap)
    return bitmap, longest, gap


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, item_chars, match_end (of the normalised text).

    options: q, rate and block_bytes of ``Benchmark``.
    """
    items = Benchmark(benchmark, item_col, item_text_col, **options)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            found = items.find(b.column("text").to_pylist())
            if found:
                yield batch(MATCHES, dict(zip(MATCHES.names, map(list, zip(*((ids[k], *x) for k, *x in found))))))

    return text_rows(df, id_col, text_col).mapInArrow(match, MATCHES_DDL)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` in which no item is found, with all their columns."""
    small_batches(df.sparkSession)
    items = Benchmark(benchmark, **options)

    def leaks(text: pd.Series) -> pd.Series:
        hit = np.zeros(len(text), bool)
        hit[[k for k, *_ in items.find([t if isinstance(t, str) else None for t in text])]] = True
        return pd.Series(hit)

    return df.where(~F.pandas_udf(leaks, "boolean")(F.col(text_col)))
