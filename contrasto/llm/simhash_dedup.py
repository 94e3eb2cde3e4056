"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits over word shingles.  Two that differ in at most 2 bits agree in one of three blocks of bits;
so for each block the fingerprints are sorted into tries whose first bits are that block, and a task joins each trie with itself
below the block: it walks pairs of nodes together, adds up the bits in which they differ and drops a pair
once it exceeds the budget.  A trie with more fingerprints than a task should hold is cut further down: its node
pairs of the next k bits within the budget become tasks of their own.  Tasks return spanning forests of their links,
never all pairs, and connected components join these.  Equal fingerprints are one node (aggregated before any shuffle).

Defined cases: null and empty texts have no words, fingerprint 0, and link like any other; texts of fewer words than a
shingle hash their whole word sequence; repeated rows each give a row; a null doc_id is never a component_id
unless its component has no other row (then null); a bit set in exactly half the hashes is 0; the hashes of a very long text
take 8 bytes a word; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import batch, materialize, text_rows
from contrasto.llm.components import components

SHINGLE = 3
SEED = 42
BUDGET = 2
#: (shift to the block's lowest bit, width): three blocks, one more than the budget.
BLOCKS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of one trie in one task; larger tries are cut.
TRIE_LIMIT = 20_000
#: Node pairs that a walk holds at a time.
PAIRS_AT_A_TIME = 1_000_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's UTF-8 bytes."""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        h = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        h = [digest(line[a:z], seed) for a, z in zip(starts, ends[shingle - 1 :].tolist())]
    cells = np.array(h, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(cells[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"") for t in text], np.uint64).view(np.int64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), and the columns of ``more``."""
    rows = text_rows(df, id_col, text_col, *more)
    kept = [c for c in rows.columns if c not in ("doc_id", "text")]
    return rows.select("doc_id", F.pandas_udf(_fingerprints, "long")("text").alias("fp"), *kept)


def walk(keys: np.ndarray, pairs: list[np.ndarray], depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Join tries below ``depth``.  keys: within each trie sorted, as unsigned 64-bit; pairs: arrays lo1, hi1, lo2, hi2, differing bits.

    A node is a range of keys.  Yields index arrays (i, j) of keys within the budget, i < j or of different ranges.
    """
    stack = [(depth, *pairs)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, a, b, c, e, diff = stack.pop()
        if len(a) > PAIRS_AT_A_TIME:
            half = len(a) // 2
            stack += [(d, *(x[:half] for x in (a, b, c, e, diff))), (d, *(x[half:] for x in (a, b, c, e, diff)))]
            continue
        same = a == c
        live = np.where(same, b - a > 1, (b > a) & (e > c))
        leaf = live & np.where(same, b - a == 2, (b - a == 1) & (e - c == 1))
        if leaf.any():
            i, j = a[leaf], np.where(same, c + 1, c)[leaf]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            yield i[near], j[near]
        live &= ~leaf
        if not live.any():
            continue
        a, b, c, e, diff, same = (x[live] for x in (a, b, c, e, diff, same))
        if d == 64:  # equal keys of two ranges
            yield a, c
            continue
        if d not in ones:
            bit = (keys >> np.uint64(63 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        s = ones[d]
        m1, m2 = b - (s[b] - s[a]), e - (s[e] - s[c])
        room = diff < budget
        cross = room & ~same
        new = [
            np.concatenate([a, m1, a[room], m1[cross]]),
            np.concatenate([m1, b, m1[room], b[cross]]),
            np.concatenate([c, m2, m2[room], c[cross]]),
            np.concatenate([m2, e, e[room], m2[cross]]),
            np.concatenate([diff, diff, diff[room] + 1, diff[cross] + 1]),
        ]
        full = (new[1] > new[0]) & (new[3] > new[2]) & ~((new[0] == new[2]) & (new[1] - new[0] < 2))
        if full.any():
            stack.append((d + 1, *(x[full] for x in new)))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index of each index's component."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            apart = hi != lo
            if not apart.any():
                break
            i, j, hi, lo = i[apart], j[apart], hi[apart], lo[apart]
            np.minimum.at(root, hi, lo)
            while not np.array_equal(root, nxt := root[root]):
                root = nxt
    return root


TASK = "block int, value long, a long, b long, side int, fp long, node long, k int"


def _partners(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """An index that each index is linked with, itself if there is none."""
    other = np.arange(n)
    for i, j in links:
        for u, v in ((i, j), (j, i)):
            new = other[u] == u
            other[u[new]] = v[new]
    return other


def _join_tries(t: dict[str, np.ndarray], ends: Callable = forest) -> Iterator[pa.RecordBatch]:
    """Whole tries, sorted by (block, value, a, b, side, turned fingerprint)."""
    turn = np.array([64 - s - w for s, w in BLOCKS], np.uint64)[t["block"]]
    fp = t["fp"].view(np.uint64)
    keys = np.where(turn == 0, fp, (fp << turn) | (fp >> ((np.uint64(64) - turn) % np.uint64(64))))
    order = np.lexsort((keys, t["side"], t["b"], t["a"], t["value"], t["block"]))
    t = {k: v[order] for k, v in t.items()}
    keys = keys[order]
    n = len(keys)
    new = np.zeros(n, bool)
    new[0] = True
    for k in ("block", "value", "a", "b"):
        new[1:] |= t[k][1:] != t[k][:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    middle = last - np.add.reduceat(t["side"].astype(np.int64), first)  # side 1 comes last
    own = t["a"][first] == t["b"][first]
    depth = np.array([w for _, w in BLOCKS])[t["block"][first]] + t["k"][first]
    diff = np.bitwise_count(t["a"][first] ^ t["b"][first]).astype(np.int64)
    lo1, hi1 = first, np.where(own, last, middle)
    lo2, hi2 = np.where(own, first, middle), last

    def links():
        for d in np.unique(depth):
            at = depth == d
            yield from walk(keys, [lo1[at], hi1[at], lo2[at], hi2[at], diff[at]], int(d))

    root = ends(n, links())
    linked = np.flatnonzero(root != np.arange(n))
    if len(linked):
        yield batch(EDGES, {"u": t["node"][linked], "v": t["node"][root[linked]]})


def join_tries(batches: Iterator[pa.RecordBatch], ends: Callable = forest) -> Iterator[pa.RecordBatch]:
    """Tries as they come, sorted; about 200,000 fingerprints at a time, cut between tries."""
    held: list[pa.RecordBatch] = []
    n = 0

    def arrays(table):
        return {c: table.column(c).to_numpy() for c in table.column_names}

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n > 200_000:
            t = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(n, bool)
            for c in ("block", "value", "a", "b"):
                x = t.column(c).to_numpy()
                same &= x == x[-1]
            cut = n - int(same.sum())
            if cut:
                yield from _join_tries(arrays(t.slice(0, cut)), ends)
                held, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield from _join_tries(arrays(pa.Table.from_batches(held)), ends)


def link_fingerprints(nodes: DataFrame, trie_limit: int = TRIE_LIMIT, partners: bool = False) -> DataFrame:
    """nodes: distinct fp with a long node id.  Edges (u, v) whose components are those of the links; or, as partners, one link of each node and trie."""
    spark = nodes.sparkSession
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("value")) for i, (s, w) in enumerate(BLOCKS)])
    routed = nodes.select("fp", "node", F.explode(blocks).alias("x")).select("fp", "node", "x.block", "x.value")
    large = routed.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > trie_limit)
    cut = large.select("block", "value", F.least(F.lit(40), F.ceil(F.log2(F.col("n") / trie_limit)) + 2).cast("int").alias("k"))
    routed = routed.join(cut, ["block", "value"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    # the k bits after the block, in the turned order
    width = F.element_at(F.array(*[F.lit(w) for _, w in BLOCKS]), F.col("block") + 1)
    shift = F.element_at(F.array(*[F.lit(s) for s, _ in BLOCKS]), F.col("block") + 1)
    turned = "(shiftleft(fp, 64 - shift - width) | CASE WHEN shift + width = 64 THEN 0L ELSE shiftrightunsigned(fp, shift + width) END)"
    routed = routed.withColumn("width", width).withColumn("shift", shift)
    routed = routed.withColumn("p", F.expr(f"CASE WHEN k = 0 THEN 0L ELSE shiftrightunsigned(shiftleft({turned}, width), 64 - k) END"))
    masks = [(k, m) for k in range(41) for m in {0} | {1 << i for i in range(k)} | {(1 << i) | (1 << j) for i in range(k) for j in range(i)}]
    routed = routed.join(F.broadcast(spark.createDataFrame(masks, "k int, mask long")), "k")
    joined = partial(join_tries, ends=_partners) if partners else join_tries
    tasks = routed.selectExpr("block", "value", "least(p, p ^ mask) AS a", "greatest(p, p ^ mask) AS b", "CAST(p > (p ^ mask) AS int) AS side", "fp", "node", "k")
    return tasks.repartition("block", "value", "a", "b").sortWithinPartitions("block", "value", "a", "b").mapInArrow(joined, "u long, v long")


def simhash_components(fps: DataFrame, trie_limit: int = TRIE_LIMIT) -> DataFrame:
    """fps: doc_id, fp.  Per distinct fp: fp, component_id.  Fingerprints are their own nodes, so rows without an id link too."""
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    linked = components(link_fingerprints(nodes.select("fp", F.col("fp").alias("node")), trie_limit)).withColumnRenamed("node", "fp")
    marked = nodes.join(linked, "fp", "left")
    smallest = materialize(marked.where("root is not null").select(F.col("root").alias("fp"), "least").unionByName(nodes.join(linked.select(F.col("root").alias("fp")).distinct(), "fp")).groupBy("fp").agg(F.min("least").alias("component_id")), "simhash")
    marked = marked.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return marked.join(smallest.withColumnRenamed("fp", "root"), "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = materialize(fingerprints(df, id_col, text_col), "simhash")
    out = fps.join(simhash_components(fps), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
