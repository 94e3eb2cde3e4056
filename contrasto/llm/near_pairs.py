"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash tries, then an exact completion.

Rows are sets of 64-bit hashes of five-word shingles; equal sets are one node, the 64-bit hash of the set, with the SimHash of the set.
Two sets of similarity 0.8 or more share one of the first n - ceil(0.8 n) + 1 hashes of each in any order of all hashes; the order here
has the rarer first, by classes of counts in a table whose size follows the input and which lies in the shared folder.  Hashes that the
table knows to be in one node only come first and are left out, so few nodes remain, and a passage that many documents have is seldom
among the first.

The links of the remaining nodes come in three steps, each between components that are still apart, and every candidate is verified by
its whole sets, so the links are exact.
1. The trie self-join of the SimHash operator, over all remaining nodes' fingerprints, with its bit budget.
2. Rounds: of each shared hash's nodes, sorted as in a trie of turned fingerprints, those outside the largest component are compared
   with the ones beside them, and each node's nearest by differing bits are verified.
3. All pairs left that share such a hash and that size and position of it allow, so no link is lost to the fingerprints.
Texts are read again for each step and never shuffled.

Defined cases: words are those of the SimHash; texts of fewer words than a shingle are one shingle of all their words,
null and empty texts and others without words equal one another; repeated rows are one node; of a component's rows none is
preferred here; a very long text takes 8 bytes a word; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import batch, materialize, new_path, raw_texts
from contrasto.llm.components import components
from contrasto.llm.simhash_dedup import _LOWER, link_fingerprints

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Slots of one part of the table of classes (1 byte each); a task holds one part at a time.
PART_LOG2 = 22
#: Hashes that a task holds at a time (8 bytes each), unless one text has more.
HELD = 4_000_000
#: Nearest nodes that a node tries, by round.
ROUNDS = (8, 24)
#: Nodes after a node that it is compared with, in the order of turned fingerprints.
WINDOW = 64
#: Marks of the nodes whose sets are written (1 bit each); a few others with the same mark are written too.
MARKS_LOG2 = 24
SETS = pa.schema([("row", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])
SLOTS = pa.schema([("part", pa.int32()), ("slots", pa.binary())])
PREFIX = pa.schema([("hash", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("fp", pa.int64())])
WHOLE = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
NEAREST = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("bits", pa.int32())])


def shingles(raw: bytes) -> np.ndarray:
    """The sorted set of hashes of a text's UTF-8 bytes."""
    words = raw.translate(_LOWER).split()
    line = b" ".join(words)
    n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.unique(np.array([digest(line[a:z]) for a, z in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def set_fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed number."""
    ones = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in raw_texts(b.column("text"))]
        yield batch(SETS, {"row": b.column("row"), "node": [_node(s) for s in sets], "n": [len(s) for s in sets]})


def _some_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Nodes and their sets, each node once a task; about ``HELD`` hashes at a time."""
    seen, nodes, sets, n = set(), [], [], 0
    for b in batches:
        for t in raw_texts(b.column("text")):
            s = shingles(t)
            k = _node(s)
            if k in seen:
                continue
            seen.add(k)
            nodes.append(k)
            sets.append(s)
            n += len(s)
            if n >= HELD:
                yield nodes, sets
                nodes, sets, n = [], [], 0
    if nodes:
        yield nodes, sets


def pack_slots(slots: np.ndarray) -> bytes:
    """Sorted slots of a part as steps, all their lowest bytes first, so that the higher ones compress to nothing."""
    return np.diff(slots, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_slots(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64))


def count_classes(n: np.ndarray) -> np.ndarray:
    """0 for counts of 0 and 1, then rising with the logarithm up to 2^21."""
    return np.where(n > 1, np.minimum(255, 12 * np.log2(np.maximum(n, 1))), 0).astype(np.uint8)


class Classes:
    """Classes of counts by the hashes' first bits, in parts under ``path``."""

    def __init__(self, rows: DataFrame, hashes: int):
        self.log2 = max(16, (2 * hashes).bit_length())
        self.part_log2 = min(PART_LOG2, self.log2)
        self.path = new_path(rows.sparkSession, "near-classes")
        log2, part_log2 = self.log2, self.part_log2

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sets in _some_sets(batches):
                at = np.sort(np.concatenate(sets) >> np.uint64(64 - log2)).astype(np.int64)
                part = at >> part_log2
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for a, z in zip(first, np.append(first[1:], len(at))):
                    yield batch(SLOTS, {"part": [int(part[a])], "slots": [pack_slots(at[a:z] - (part[a] << part_log2))]})

        def classes(key: tuple, t: pa.Table) -> pa.Table:
            n = np.zeros(1 << part_log2, np.int32)
            for raw in t.column("slots"):
                n += np.bincount(unpack_slots(raw.as_py()), minlength=len(n)).astype(np.int32)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([count_classes(n).tobytes()], pa.binary())})

        made = rows.select("text").mapInArrow(slots, "part int, slots binary").groupBy("part").applyInArrow(classes, "part int, classes binary")
        made.write.option("compression", "zstd").partitionBy("part").parquet(self.path)

    def of(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """Classes of each set's hashes."""
        h = np.concatenate(sets)
        order = np.argsort(h)
        at = (h[order] >> np.uint64(64 - self.log2)).astype(np.int64)
        out = np.zeros(len(h), np.uint8)
        part = at >> self.part_log2
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, z in zip(first, np.append(first[1:], len(at))):
            out[order[a:z]] = _read_classes(self.path, int(part[a]))[at[a:z] - (part[a] << self.part_log2)]
        return np.split(out, np.cumsum([len(s) for s in sets])[:-1])


@lru_cache(1)
def _read_classes(path: str, part: int) -> np.ndarray:
    where, folder = fs.FileSystem.from_uri(path)
    return np.frombuffer(pq.read_table(f"{folder}/part={part}", filesystem=where, columns=["classes"], partitioning=None).column("classes")[0].as_buffer(), np.uint8)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by hash, cut between hashes."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        h = t.column("hash").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None:
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash and node; those whose hash another node has too, once each."""
    for t in _buckets(batches):
        yield from _repeated(t)


def _repeated(t: pa.Table) -> Iterator[pa.RecordBatch]:
    if t.num_rows > 1:
        h, node = (t.column(c).to_numpy() for c in ("hash", "node"))
        new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        t, h = t.filter(pa.array(new)), h[new]
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[1:] |= same
        keep[:-1] |= same
        yield from t.filter(pa.array(keep)).to_batches()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(c)] for c in ("x", "y")]
        good = [similar(x, y) for x, y in zip(*sets)]
        u, v = (b.column(c).to_numpy()[np.array(good, bool)] for c in ("u", "v"))
        yield batch(LINKS, {"u": u, "v": v})


def _fits(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether size allows the pairs, and what can follow the shared hash in both."""
    a, b = n[i], n[j]
    return (DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)) & ((NUM + DEN) * np.minimum(a - pos[i], b - pos[j]) >= NUM * (a + b))


def nearest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash and turned fingerprint.  For each row outside the largest component the nearest of others beside it."""
    for t in _buckets(batches):
        h, node, n, pos, fp, root, main = (t.column(c).to_numpy() for c in ("hash", "node", "n", "pos", "fp", "root", "main"))
        n, pos, stray = n.astype(np.int64), pos.astype(np.int64), root != main
        for at in range(0, t.num_rows, 20_000):
            some = np.arange(at, min(at + 20_000, t.num_rows))
            found = []
            for k in range(1, WINDOW + 1):
                some = some[some + k < t.num_rows]
                some = some[h[some] == h[some + k]]
                if not len(some):
                    break
                i = some[(stray[some] | stray[some + k]) & (root[some] != root[some + k])]
                i = i[_fits(n, pos, i, i + k)]
                bits = np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + k].view(np.uint64)).astype(np.int64)
                for u, v in ((i, i + k), (i + k, i)):
                    found.append(np.stack([u, bits, v])[:, stray[u]])
            if not found:
                continue
            u, bits, v = np.concatenate(found, axis=1)
            order = np.lexsort((node[v], bits, u))
            u, bits, v = u[order], bits[order], v[order]
            first = np.flatnonzero(np.append(True, u[1:] != u[:-1])[: len(u)])
            rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
            near = rank < most
            if near.any():
                yield batch(NEAREST, {"u": node[u[near]], "v": node[v[near]], "bits": bits[near].astype(np.int32)})


def near_groups(rows: DataFrame) -> DataFrame:
    """rows: a stable long row, text.  Per row: row, group (equal within a component)."""
    spark = rows.sparkSession
    rows = rows.select("row", "text")
    sets = materialize(rows.mapInArrow(_digests, "row long, node long, n long"), "near-sets")
    classes = Classes(rows, sets.agg(F.sum("n")).first()[0] or 0)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in _some_sets(batches):
            hashes, node, size, place, prints = [], [], [], [], []
            for k, s, c in zip(nodes, sets, classes.of(sets)):
                n = len(s)
                m = n - -(-NUM * n // DEN) + 1
                single = n - np.count_nonzero(c)
                if single >= m:
                    continue
                pos = np.arange(single, m)  # what is in one node only comes first
                hashes.append(s[np.lexsort((s, c))[pos]])
                node.append(np.full(len(pos), k))
                size.append(np.full(len(pos), n))
                place.append(pos)
                prints.append(np.full(len(pos), set_fingerprint(s)))
            if hashes:
                yield batch(PREFIX, {"hash": np.concatenate(hashes).view(np.int64), "node": np.concatenate(node), "n": np.concatenate(size).astype(np.int32), "pos": np.concatenate(place).astype(np.int32), "fp": np.concatenate(prints)})

    kind = "hash long, node long, n int, pos int, fp long"
    found = rows.mapInArrow(prefixes, kind).repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(_shared, kind)
    found = materialize(found, "near-shared")
    used = found.select(F.shiftrightunsigned("node", 64 - MARKS_LOG2).alias("mark")).distinct().toArrow()
    marks = np.zeros(1 << MARKS_LOG2, bool)
    marks[used.column("mark").to_numpy()] = True
    marked_nodes = spark.sparkContext.broadcast(np.packbits(marks, bitorder="little"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            out = {}
            for t in raw_texts(b.column("text")):
                s = shingles(t)
                k = _node(s)
                at = (k & (1 << 64) - 1) >> (64 - MARKS_LOG2)
                if k not in seen and marked_nodes.value[at >> 3] >> (at & 7) & 1:
                    seen.add(k)
                    out[k] = s.tobytes()
            yield batch(WHOLE, {"node": list(out), "hashes": list(out.values())})

    whole = materialize(rows.mapInArrow(hashes, "node long, hashes binary").dropDuplicates(["node"]), "near-whole")

    def verified(pairs: DataFrame) -> DataFrame:
        x = pairs.join(whole.select(F.col("node").alias("u"), F.col("hashes").alias("x")), "u")
        xy = x.join(whole.select(F.col("node").alias("v"), F.col("hashes").alias("y")), "v")
        return materialize(xy.select("u", "v", "x", "y").mapInArrow(_verify, "u long, v long"), "near-links")

    tried = links = None

    def link(pairs: DataFrame) -> DataFrame:
        """Verify pairs not tried before; the components of all links so far."""
        nonlocal tried, links
        pairs = pairs.selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "near-tried")
        good = verified(pairs)
        tried, links = (pairs, good) if tried is None else (tried.unionByName(pairs), links.unionByName(good))
        return components(links)

    def apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
        """Shared hashes whose nodes are in several components, with each node's root and the root of most of them."""
        marked = shared.select(*found.columns).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by = marked.groupBy("hash", "root").agg(F.count("*").alias("k")).groupBy("hash").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("most"))
        return materialize(marked.join(by.where("roots > 1").selectExpr("hash", "most.root AS main"), "hash"), "near-apart")

    prints = materialize(found.select("fp", "node").distinct(), "near-prints")
    one = prints.groupBy("fp").agg(F.min("node").alias("one"))
    same = prints.join(one, "fp").where("node <> one").selectExpr("node AS u", "one AS v")
    left = apart(found, link(link_fingerprints(one.selectExpr("fp", "one AS node"), partners=True).unionByName(same)))
    for k, most in enumerate(ROUNDS):
        turn = f"CAST(pmod(hash + {17 * k}, 64) AS int)"
        turned = F.expr(f"shiftleft(fp, {turn}) | shiftrightunsigned(fp, 64 - {turn})")
        beside = left.withColumn("turned", turned).repartition("hash").sortWithinPartitions("hash", "turned").drop("turned").mapInArrow(lambda b, most=most: nearest(b, most), "u long, v long, bits int").distinct()
        ranked = beside.withColumn("rank", F.expr("row_number() OVER (PARTITION BY u ORDER BY bits, v)"))
        left = apart(left, link(ranked.where(F.col("rank") <= most)))
    # all that is left, from the side that is not in the largest component
    fits = f"{DEN} * least(n, m) >= {NUM} * greatest(n, m) AND {NUM + DEN} * least(n - pos, m - qos) >= {NUM} * (n + m)"
    other = left.select("hash", F.col("node").alias("v"), F.col("n").alias("m"), F.col("pos").alias("qos"), F.col("root").alias("toor"))
    rest = left.where("root <> main").withColumnRenamed("node", "u").join(other, "hash").where(f"root <> toor AND {fits}")
    root = link(rest.select("u", "v")).select("node", "root")
    return sets.join(root, "node", "left").select("row", F.coalesce("root", "node").alias("group"))
