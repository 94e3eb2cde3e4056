"""Token counts that follow edits.

A document's text is cut into leaves of about ``LEAF`` characters at pre-token edges (``edge``), which no token of the word
tokenizers crosses; so the count of the text is the sum of its leaves' counts.  A segment tree over the leaves holds the sums
of tokens and of characters.  Trees are kept: ``build_trees`` returns them as rows (id, text, sums), to be written and read
back, and ``apply_edits`` takes such rows with a table of edits and returns the rows after them, for the next round.

An edit replaces a range of characters.  Its leaves are found by the sums of characters; only the leaves it touches are encoded
again, with the leaves beside them while the place where they join is no pre-token edge any more (the boundary context).  Then the sums
above them are updated; only where a region needs more leaves than it had, the tree is laid out anew from the leaves' sums.
With tokenizers whose tokens may cross white space, and for texts that hold the string of a special token, a document is one leaf.

The registered query builds the trees of all documents, writes them, applies the edits of ``cleaning_edits`` (each repeated line
goes, each base span of personal data becomes a mark) from a table and counts again.

Defined cases: null text is empty (0 tokens); edits of a round are in the positions of the text before it, in any order: by start, end
and text, positions beyond the text are its end, and of overlapping edits the first counts; edits with a null position are none, a
null new text is empty; edits with a null id belong to documents with a null id; repeated rows each give a row, and the edits
of an id go to each (with a column ``version``, the xxhash64 of the text they are meant for, only to rows with that text);
very long texts have deep trees, an edit reads a logarithm of their leaves; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import batch, materialize, text_rows
from contrasto.llm.pii import KINDS, base_spans
from contrasto.llm.tokens import TOKENIZER, PieceEncoder, encoder

LEAF = 256
#: Marks of the ids that have edits (1 bit each); a few others with the same mark are joined too.
MARKS_LOG2 = 24
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_EDGE = re.compile(r"[ \t\n\x0b\x0c\r]|(?<=[A-Za-z0-9])[!-/:-@\[-`{-~]")
Edit = tuple[int, int, str]


def edge(text: str, at: int) -> bool:
    """Whether a pre-token surely ends before ``at``: at ASCII white space, and at ASCII punctuation after an ASCII letter or digit."""
    return at <= 0 or at >= len(text) or _EDGE.match(text, at) is not None


def cut(text: str, lo: int, hi: int, leaf: int = LEAF) -> list[int]:
    """Ends of leaves of about ``leaf`` characters over text[lo:hi], whose own ends are edges."""
    ends = []
    while lo < hi:
        m = _EDGE.search(text, lo + leaf, hi) if lo + leaf < hi else None
        lo = m.start() if m else hi
        ends.append(lo)
    return ends


class CountTree:
    """Token counts of a text's leaves and their sums.  ``tokens`` and ``chars`` are heaps: the root is 1, the leaves are the last half."""

    #: Strings of special tokens; a text that holds one is one leaf.
    special: tuple[str, ...] = ()

    def __init__(self, text: str, tokens: list[int], chars: list[int], divisible: bool):
        self.text, self.tokens, self.chars, self.divisible, self.encoded = text, tokens, chars, divisible, 0

    @staticmethod
    def build(text: str, count: Callable[[str], int], divisible: bool = True, leaf: int = LEAF) -> CountTree:
        ends = cut(text, 0, len(text), leaf) if divisible else [len(text)]
        tree = CountTree(text, [], [], divisible)
        tree._lay([count(text[a:z]) for a, z in zip([0, *ends], ends)], [z - a for a, z in zip([0, *ends], ends)])
        return tree

    def _lay(self, tokens: list[int], chars: list[int]) -> None:
        size = 1 << max(0, len(tokens) - 1).bit_length()
        for name, leaves in (("tokens", tokens), ("chars", chars)):
            level = np.zeros(size, np.int64)
            level[: len(leaves)] = leaves
            levels = [level]
            while len(level) > 1:
                level = level.reshape(-1, 2).sum(1)
                levels.append(level)
            setattr(self, name, np.concatenate([[0], *levels[::-1]]).tolist())

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return len(self.tokens) // 2

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last one with characters for the text's end) and where it begins."""
        k, start, at = 1, 0, min(at, self.chars[1] - 1)
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def _set(self, k: int, tokens: int, chars: int) -> None:
        k += self.size
        dt, dc = tokens - self.tokens[k], chars - self.chars[k]
        while k and (dt or dc):
            self.tokens[k] += dt
            self.chars[k] += dc
            k >>= 1

    def edit(self, edits: list[Edit], count: Callable[[str], int], divisible: bool = True, leaf: int = LEAF) -> int:
        """Apply a round of edits; returns how many counted.  ``divisible``: whether the new text may be cut."""
        n, old = len(self.text), self.text
        some: list[Edit] = []
        for a, z, new in sorted((min(max(a, 0), n), min(max(a, z, 0), n), new or "") for a, z, new in edits):
            if not some or a >= some[-1][1]:
                some.append((a, z, new))
        if not some:
            return 0
        out, at = [], 0
        for a, z, new in some:
            out += [old[at:a], new]
            at = z
        self.text = text = "".join([*out, old[at:]])
        divisible = divisible and not (self.special and any(s in text for s in self.special))
        if not (divisible and self.divisible) or not n:
            again = CountTree.build(text, count, divisible, leaf)
            self.tokens, self.chars, self.divisible = again.tokens, again.chars, divisible
            self.encoded += len(text)
            return len(some)
        # regions: first and last leaf, and their range in the new text
        regions: list[list[int]] = []
        shift = 0
        for a, z, new in some:
            (lo, start), (hi, last) = self._leaf(a), self._leaf(max(a, z - 1))
            end = last + self.chars[self.size + hi]
            if regions and lo <= regions[-1][1]:
                old_end = regions[-1][4]
                regions[-1][1], regions[-1][4] = max(hi, regions[-1][1]), max(end, old_end)
            else:
                regions.append([lo, hi, start + shift, 0, end])
            shift += len(new) - (z - a)
            regions[-1][3] = regions[-1][4] + shift
        done: list[list[int]] = []
        ahead = regions[::-1]
        while ahead:
            r = ahead.pop()
            while True:
                if not edge(text, r[3]):
                    if ahead and ahead[-1][0] == r[1] + 1:
                        nxt = ahead.pop()
                        r[1], r[3] = nxt[1], nxt[3]
                    else:
                        r[1] += 1
                        r[3] += self.chars[self.size + r[1]]
                elif not edge(text, r[2]):
                    if done and done[-1][1] == r[0] - 1:
                        before = done.pop()
                        r[0], r[2] = before[0], before[2]
                    else:
                        r[0] -= 1
                        r[2] -= self.chars[self.size + r[0]]
                else:
                    break
            done.append(r)
        fresh = []
        for lo, hi, start, end, _ in done:
            ends = cut(text, start, end, leaf)
            fresh.append((lo, hi, [(count(text[a:z]), z - a) for a, z in zip([start, *ends], ends)]))
            self.encoded += end - start
        if all(len(x) <= hi - lo + 1 for lo, hi, x in fresh):
            for lo, hi, x in fresh:
                for k in range(lo, hi + 1):
                    self._set(k, *(x[k - lo] if k - lo < len(x) else (0, 0)))
        else:
            leaves, at = [], 0
            own = list(zip(self.tokens[self.size :], self.chars[self.size :]))
            for lo, hi, x in fresh:
                leaves += own[at:lo] + x
                at = hi + 1
            leaves = [x for x in leaves + own[at:] if x[1]] or [(0, 0)]
            self._lay([x[0] for x in leaves], [x[1] for x in leaves])
        return len(some)


def repeated_lines(text: str) -> Iterator[tuple[int, int]]:
    """Lines of more than white space that stood before, with their line ends."""
    seen, at = set(), 0
    for line in text.split("\n"):
        key = line.strip()
        if key in seen:
            yield at, min(len(text), at + len(line) + 1)
        elif key:
            seen.add(key)
        at += len(line) + 1


def cleaning_edits(text: str) -> list[Edit]:
    """Each repeated line goes; each base span of personal data becomes ``<kind>``; of overlapping edits the first stays."""
    edits = [(a, z, "") for a, z in repeated_lines(text)] + [(a, z, f"<{KINDS[k]}>") for k, a, z in base_spans(text)]
    out: list[Edit] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


TREES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("tokens", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("divisible", pa.bool_()), *((n, pa.int64()) for n in ("n_before", "n_edits", "n_chars_encoded"))])
TREES_DDL = "doc_id long, text string, tokens array<long>, chars array<long>, divisible boolean, n_before long, n_edits long, n_chars_encoded long"
EDITS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("new", pa.string()), ("version", pa.int64())])
EDITS_DDL = "doc_id long, start long, end long, new string, version long"


def _counter(enc: PieceEncoder) -> Callable[[str], int]:
    return lambda t: len(enc.ids(t)) // 4


def _row(doc_id: int | None, t: CountTree, n_before: int, n_edits: int) -> tuple:
    return doc_id, t.text, t.tokens, t.chars, t.divisible, n_before, n_edits, t.encoded


def build_trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per row of ``df``: doc_id, text, the heaps of sums, whether the text is cut, and of the last round the tokens before, the edits, and the characters encoded."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        count = _counter(enc)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            trees = [CountTree.build(t, count, enc.by_piece and not any(s in t for s in enc.special)) for t in texts]
            rows = [_row(d, t, t.total, 0) for d, t in zip(b.column("doc_id").to_pylist(), trees)]
            if rows:
                yield batch(TREES, dict(zip(TREES.names, map(list, zip(*rows)))))

    return text_rows(df, id_col, text_col).mapInArrow(build, TREES_DDL)


def _mark(doc_id: str) -> str:
    return f"shiftrightunsigned(xxhash64({doc_id}), {64 - MARKS_LOG2})"


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """trees: rows of ``build_trees`` or of an earlier round, best read from a written table; edits: doc_id, start, end, new, and version if wanted.

    Only rows whose id may have edits are shuffled; a bitmap of fixed size says which.
    """
    spark = trees.sparkSession
    keys = ["doc_id"] + ["version"] * ("version" in edits.columns)
    wanted = edits.where("start is not null and end is not null").selectExpr(*keys, "struct(CAST(start AS long) AS start, CAST(end AS long) AS end, new) AS e").groupBy(*keys).agg(F.collect_list("e").alias("edits"))
    wanted = materialize(wanted, "edits")
    used = wanted.selectExpr(f"{_mark('doc_id')} AS mark").distinct().toArrow().column("mark").to_numpy()
    marks = np.zeros(1 << MARKS_LOG2, bool)
    marks[used] = True
    shared = spark.sparkContext.broadcast(np.packbits(marks, bitorder="little"))

    @F.pandas_udf("boolean")
    def may_have(mark: pd.Series) -> pd.Series:
        at = mark.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))

    kept = trees.selectExpr("doc_id", "text", "tokens", "chars", "divisible", "element_at(tokens, 2) AS n_before", "0L AS n_edits", "0L AS n_chars_encoded")
    hit = may_have(F.expr(_mark("doc_id")))
    touched = kept.where(hit).withColumn("version", F.xxhash64("text"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    joined = touched.alias("t").join(wanted.alias("w"), same, "left").select("t.doc_id", "t.text", "t.tokens", "t.chars", "t.divisible", "w.edits")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        count = _counter(enc)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                t = CountTree(r["text"], r["tokens"], r["chars"], r["divisible"])
                t.special = tuple(enc.special)
                before = t.total
                n = t.edit([(e["start"], e["end"], e["new"]) for e in r["edits"] or []], count, enc.by_piece)
                rows.append(_row(r["doc_id"], t, before, n))
            if rows:
                yield batch(TREES, dict(zip(TREES.names, map(list, zip(*rows)))))

    return kept.where(~hit).unionByName(joined.mapInArrow(apply, TREES_DDL))


def cleaning_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``cleaning_edits`` of all rows as a table of edits."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *e, v) for d, t, v in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "version"))) for e in cleaning_edits(t or "")]
            if rows:
                yield batch(EDITS, dict(zip(EDITS.names, map(list, zip(*rows)))))

    rows = text_rows(df, id_col, text_col).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.mapInArrow(find, EDITS_DDL).distinct()


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per row of ``df``: tokens before and after its cleaning edits, the edited length, and the characters encoded for the edits."""
    trees = materialize(build_trees(df, id_col, text_col, tokenizer), "trees")
    after = apply_edits(trees, cleaning_table(df, id_col, text_col), tokenizer)
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), "n_edits", F.element_at("tokens", 2).alias("n_tokens_edited"), F.element_at("chars", 2).alias("n_chars_edited"), "n_chars_encoded")
