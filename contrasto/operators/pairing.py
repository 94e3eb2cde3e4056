"""Pairs of a subject's documents, computed where the subject's anchors lie.

All buckets of a subject (both routes) are made of its own anchors, so anchors are dealt once, by subject and with what scores
read, and a task takes whole subjects, some thousand anchors at a time, as arrays: members of buckets, overlapping chunks, pools,
rings, scores and best partners follow ``candidates``, whose steps do the same for subjects too large for one task.  Only chosen
pairs leave the task, one row per subject and pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Anchors that a task takes at a time, in whole subjects.
ANCHORS_AT_A_TIME = 20_000
#: Pairs that are looked at together, in whole chunks.
PAIRS_AT_A_TIME = 2_000_000

SCORES = "token_jaccard double, date_mismatch boolean, number_mismatch boolean, same_source_domain boolean, support_score double, conflict_score double"
#: What leaves a task; subjects of references follow where they are asked for.
PAIRS = f"subject string, doc_a string, doc_b string, kp boolean, ner boolean, slots array<string>, several boolean, {SCORES}"
SMALL = "route string, b1 string, subject string, b2 string, doc_a string, doc_b string"


def _ranks(values) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the strings, -1 for null; and the distinct strings in order."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    rank[-1] = -1
    return rank[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def _filled(codes: np.ndarray, names: pa.Array) -> np.ndarray:
    """Whether each code names a string that is not empty."""
    return codes >= (1 if len(names) and names[0].as_py() == "" else 0)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin a new group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _places(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups by their heads: each row's group, place within it, and the groups' sizes."""
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(new)))
    return group, np.arange(len(new)) - start[group] if len(new) else group, size


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count says, with 0, 1, 2 and so on."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def _all_pairs(place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of one group; rows of a group lie together."""
    i, k = _spread(size - 1 - place)
    return i, i + 1 + k


def _best(group: np.ndarray, most: int, *keys: np.ndarray) -> np.ndarray:
    """The first ``most`` rows of each group by the keys, the weightiest last."""
    order = np.lexsort((*keys, group))
    return order[_places(_heads(group[order]))[1] < most]


def round6(x: np.ndarray) -> np.ndarray:
    """Rounded to six places, halves away from zero, as the decimal that is written says."""
    scaled = x * 1e6
    out = np.rint(scaled) / 1e6
    near_half = np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-6
    for i in np.flatnonzero(near_half):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


class _Piece:
    """Anchors of whole subjects as arrays."""

    def __init__(self, table: pa.Table, config):
        self.config = config
        col = lambda c: table.column(c).combine_chunks()
        self.subject, self.subjects = _ranks(col("subject"))
        self.doc, self.docs = _ranks(col("doc_id"))
        self.kp, self.kps = _ranks(col("kp_key"))
        self.slot, self.slots = _ranks(col("slot"))
        conf = col("confidence").to_numpy(zero_copy_only=False).astype(np.float64)
        unknown = col("confidence").is_null().to_numpy(zero_copy_only=False)
        self.order = np.where(unknown, -np.inf, -conf)  # the highest first; unknown ones before them, as Spark sorts
        self.seq = col("seq").to_numpy(zero_copy_only=False)
        self.ner = col("open").to_numpy(zero_copy_only=False).astype(bool)
        # what scores read: one row a document, that of its first anchor here
        at = np.lexsort((self.seq, self.doc))
        self.row = at[_heads(self.doc[at])]
        self.trust = np.maximum(0.0, np.where(unknown, 0.0, conf))[self.row]
        several = col("several").to_numpy(zero_copy_only=False).astype(bool)
        self.several = several[self.row]
        self.dates, self.no_dates, self.dates_known = self._sets(col("dates"))
        self.numbers, self.no_numbers, self.numbers_known = self._sets(col("numbers"))
        domain, names = _ranks(col("source_domain"))
        self.domain = np.where(_filled(domain, names), domain, -1)[self.row]
        self._tokens(col("tokens").take(pa.array(self.row)))

    def _sets(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, names = _ranks(pc.fill_null(column, "[]"))
        empty = pc.equal(names, "[]").to_numpy(zero_copy_only=False)
        return codes[self.row], empty[codes][self.row], ~column.is_null().to_numpy(zero_copy_only=False)[self.row]

    def _tokens(self, lists: pa.Array) -> None:
        """Distinct (document, token) in order, tokens by name; null is a token that no other step names."""
        doc = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        token, names = _ranks(pc.list_flatten(lists))
        self.names = len(names) + 1
        self.keys = np.unique(doc * self.names + token + 1)
        self.token_doc, self.token = self.keys // self.names, self.keys % self.names - 1
        self.n_tokens = np.bincount(self.token_doc, minlength=len(self.docs))
        self.token_start = np.cumsum(self.n_tokens) - self.n_tokens

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many tokens documents have in common."""
        swap = self.n_tokens[a] > self.n_tokens[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), np.int64)
        if not len(self.keys):
            return out
        step = max(1, PAIRS_AT_A_TIME // max(1, int(self.n_tokens.max())))
        for i in range(0, len(a), step):
            p, k = _spread(self.n_tokens[a[i : i + step]])
            key = b[i : i + step][p] * self.names + self.token[self.token_start[a[i : i + step]][p] + k] + 1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[i : i + step] = np.bincount(p[self.keys[at] == key], minlength=len(out[i : i + step]))
        return out

    def scores(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
        """As ``text.pair_scores``; and ``near``, whether the pair counts as a near-duplicate."""
        na, nb = self.n_tokens[a], self.n_tokens[b]
        overlap = np.where((na == 0) | (nb == 0), 0.0, common / np.maximum(1, na + nb - common))
        same_dates, same_numbers = self.dates[a] == self.dates[b], self.numbers[a] == self.numbers[b]
        dates, numbers = ~self.no_dates[a] & ~self.no_dates[b] & ~same_dates, ~self.no_numbers[a] & ~self.no_numbers[b] & ~same_numbers
        domain = (self.domain[a] >= 0) & (self.domain[a] == self.domain[b])
        base = overlap * 6.0 + np.sqrt(self.trust[a] * self.trust[b]) + np.where(domain, -0.75, 0.5)
        same = (~self.no_dates[a] | ~self.no_numbers[a]) & same_dates & same_numbers
        unknown_dates, unknown_numbers = ~(self.dates_known[a] & self.dates_known[b]), ~(self.numbers_known[a] & self.numbers_known[b])
        return {
            "token_jaccard": round6(overlap), "date_mismatch": dates, "number_mismatch": numbers, "same_source_domain": domain,
            "support_score": round6(base + np.where(same, 1.0, 0.0)), "conflict_score": round6(base + np.where(dates, 2.0, 0.0) + np.where(numbers, 1.5, 0.0)),
            "near": (overlap >= self.config.near_duplicate_jaccard) & (same_dates | unknown_dates) & (same_numbers | unknown_numbers),
        }

    def hash_order(self, docs: np.ndarray) -> None:
        """The places of documents in the order of their hashes."""
        need = np.unique(docs)
        names = self.docs.take(pa.array(need)).to_pylist()
        h = np.array([int.from_bytes(hashlib.sha1(x.encode("utf-8", "surrogatepass")).digest()[:8], "big") for x in names], np.uint64)
        self.place = np.zeros(len(self.docs), np.int64)
        self.place[need[np.lexsort((need, h))]] = np.arange(len(need))

    def members(self) -> None:
        """Buckets and their members: of each document the anchor with the highest confidence, the earliest of equals."""
        named = _filled(self.subject, self.subjects)
        kp = np.flatnonzero(named & _filled(self.kp, self.kps) & _filled(self.slot, self.slots))
        ner = np.flatnonzero(named & self.ner)
        at = np.concatenate([kp, ner])
        route = np.repeat(np.array([0, 1]), [len(kp), len(ner)])
        b1, b2 = np.where(route == 0, self.kp[at], -1), np.where(route == 0, self.slot[at], -1)
        s = self.subject[at]
        order = np.lexsort((self.seq[at], self.order[at], self.doc[at], b2, b1, route, s))
        at, route, b1, b2, s = (x[order] for x in (at, route, b1, b2, s))
        first = _heads(s, route, b1, b2, self.doc[at])
        at, route, b1, b2, s = (x[first] for x in (at, route, b1, b2, s))
        new = _heads(s, route, b1, b2)
        bucket, _, size = _places(new)
        self.b_subject, self.b_route, self.b_slot, self.b_kp = s[new], route[new], b2[new], b1[new]
        keep = (size > 1) & ((self.b_route == 0) | (size <= self.config.max_entity_docs))
        live = keep[bucket] if len(bucket) else np.zeros(0, bool)
        self._chunks(bucket[live], self.doc[at][live], self.kp[at][live], size)

    def _chunks(self, bucket, doc, kp, docs) -> None:
        c = self.config
        step = max(1, c.max_chunk_docs - c.chunk_overlap)
        large = docs[bucket] > c.max_chunk_docs
        # whatever lies beyond all pairs is taken in hash order somewhere
        self.hash_order(doc[docs[bucket] > min(c.all_pairs_max_docs, c.max_chunk_docs)])
        b, d, k = bucket[large], doc[large], kp[large]
        order = np.lexsort((self.place[d], b))
        b, d, k = b[order], d[order], k[order]
        i = _places(_heads(b))[1]
        first = np.maximum(0, (i - c.max_chunk_docs) // step + 1)
        row, more = _spread(i // step - first + 1)
        chunk = np.concatenate([np.zeros(int((~large).sum()), np.int64), first[row] + more])
        bucket, doc, kp = (np.concatenate([x[~large], y[row]]) for x, y in ((bucket, b), (doc, d), (kp, k)))
        order = np.lexsort((doc, chunk, bucket))
        self.bucket, self.d, self.k = bucket[order], doc[order], kp[order]
        self.chunk, self.at, self.n = _places(_heads(self.bucket, chunk[order]))

    def _eligible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.b_route[self.bucket[i]] == 0) | ((self.k[i] >= 0) & (self.k[j] >= 0) & (self.k[i] != self.k[j]))

    def runs(self, rows: np.ndarray, cost: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of whole chunks whose costs together stay within bounds (a chunk at least)."""
        if not len(rows):
            return
        total = np.cumsum(cost) // PAIRS_AT_A_TIME
        ends = np.flatnonzero(_heads(self.chunk[rows]))
        part = total[ends]
        cuts = ends[np.flatnonzero(_heads(part))]
        yield from np.split(rows, cuts[1:])

    def small(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All eligible pairs (rows) of chunks up to the bound."""
        n = self.n[self.chunk] if len(self.chunk) else self.chunk
        rows = np.flatnonzero((n > 1) & (n <= self.config.all_pairs_max_docs))
        for r in self.runs(rows, n[rows]):
            i, j = _all_pairs(self.at[r], self.n[self.chunk[r]])
            i, j = r[i], r[j]
            ok = self._eligible(i, j)
            yield i[ok], j[ok]

    def large(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (row, other row) of chunks beyond the bound: rare-token pool, filled up from the ring."""
        c = self.config
        n = self.n[self.chunk] if len(self.chunk) else self.chunk
        rows = np.flatnonzero(n > max(1, c.all_pairs_max_docs))
        p, k = _spread(self.n_tokens[self.d[rows]])
        row = rows[p]
        token = self.token[self.token_start[self.d[row]] + k]
        row, token = row[token >= 0], token[token >= 0]
        # the rarest tokens of each member, by their documents in the chunk
        order = np.lexsort((row, token, self.chunk[row]))
        row, token = row[order], token[order]
        group, _, often = _places(_heads(self.chunk[row], token))
        df = often[group] if len(group) else group
        kept = _best(row, c.rare_tokens, token, df)
        kept = np.sort(kept[df[kept] <= c.max_token_docs])
        row, token = row[kept], token[kept]
        group, place, size = _places(_heads(self.chunk[row], token))
        met = np.bincount(row, (size[group] - 1 - place) if len(row) else None, len(self.d))
        in_run = np.zeros(len(self.d), bool)
        for r in self.runs(rows, met[rows] + c.candidate_pool_size):
            in_run[:] = False
            in_run[r] = True
            yield self._pool(r, row[in_run[row]], token[in_run[row]])

    def _pool(self, rows: np.ndarray, row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, total = self.config, len(self.d)
        new = _heads(self.chunk[row], token)
        group, place, size = _places(new)
        i, j = _all_pairs(place, size[group]) if len(row) else (row, row)
        key = np.unique(row[i] * total + row[j])
        i, j = key // total, key % total
        have = np.bincount(np.concatenate([i, j]), minlength=total)
        a, o = np.concatenate([i, j]), np.concatenate([j, i])
        over = have[a] > c.candidate_pool_size
        if over.any():
            # of a pool that is too large the candidates with most tokens in common
            x, y = a[over], o[over]
            best = _best(x, c.candidate_pool_size, self.place[self.d[y]], -self.common(self.d[x], self.d[y]))
            a, o = np.concatenate([a[~over], x[best]]), np.concatenate([o[~over], y[best]])
            have = np.minimum(have, c.candidate_pool_size)
        # neighbours on the ring of hashes, before and after in turn
        order = rows[np.lexsort((self.place[self.d[rows]], self.chunk[rows]))]
        _, place, size = _places(_heads(self.chunk[order]))
        n = self.n[self.chunk[order]]
        start = np.arange(len(order)) - place
        ask, k = _spread(np.maximum(0, np.minimum(c.candidate_pool_size - have[order], n - 1)))
        k = k + 1
        at = (place[ask] + np.where(k % 2 == 1, -((k + 1) // 2), k // 2)) % n[ask]
        ring_a, ring_o = order[ask], order[start[ask] + at]
        apart = ring_a != ring_o
        key = np.unique(np.concatenate([a * total + o, ring_a[apart] * total + ring_o[apart]]))
        a, o = key // total, key % total
        ok = self._eligible(a, o)
        return a[ok], o[ok]

    def _scored(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Tokens in common and scores of pairs, each distinct pair computed once."""
        key, back = np.unique(a * len(self.docs) + b, return_inverse=True)
        u, v = key // len(self.docs), key % len(self.docs)
        common = self.common(u, v)
        return common[back], {k: x[back] for k, x in self.scores(u, v, common).items()}

    def chosen(self, large: bool) -> tuple[np.ndarray, ...]:
        """(bucket, first document, second, tokens in common) of the pairs that stay."""
        parts = []
        for i, j in self.small():
            common, s = self._scored(self.d[i], self.d[j])
            ok = ~s["near"]
            parts.append((self.bucket[i][ok], self.d[i][ok], self.d[j][ok], common[ok]))
        for i, j in self.large() if large else ():
            a, b = np.minimum(self.d[i], self.d[j]), np.maximum(self.d[i], self.d[j])
            common, s = self._scored(a, b)
            i, j, a, b, common = (x[~s["near"]] for x in (i, j, a, b, common))
            for name, most in (("support_score", self.config.support_top_k), ("conflict_score", self.config.conflict_top_k)):
                if most > 0:
                    k = _best(i, most, self.d[j], -s[name][~s["near"]])
                    parts.append((self.bucket[i][k], a[k], b[k], common[k]))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def pairs(self, large: bool) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        """Columns of the pairs, one row per subject and pair; and their subjects and documents as codes."""
        self.members()
        bucket, a, b, common = self.chosen(large)
        s, route, slot = self.b_subject[bucket], self.b_route[bucket], self.b_slot[bucket]
        order = np.lexsort((slot, route, b, a, s))
        s, a, b, route, slot, common = (x[order] for x in (s, a, b, route, slot, common))
        new = _heads(s, a, b)
        pair = np.cumsum(new) - 1
        kp = np.zeros(int(new.sum()), bool)
        ner = kp.copy()
        kp[pair[route == 0]] = True
        ner[pair[route == 1]] = True
        named = (route == 0) & _heads(s, a, b, route, slot)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(pair[named], minlength=len(kp)))])
        s, a, b, common = (x[new] for x in (s, a, b, common))
        slots = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.slots.take(pa.array(slot[named])))
        out = {"subject": self.subjects.take(pa.array(s)), "doc_a": self.docs.take(pa.array(a)), "doc_b": self.docs.take(pa.array(b)), "kp": kp, "ner": ner, "slots": slots, "several": self.several[a] & self.several[b]}
        scores = self.scores(a, b, common)
        del scores["near"]
        return out | scores, s, a, b

    def last(self, s: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The row of the last anchor of each subject and document."""
        order = np.lexsort((self.seq, self.doc, self.subject))
        key = self.subject[order] * len(self.docs) + self.doc[order]
        return order[np.searchsorted(key, s * len(self.docs) + doc, side="right") - 1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole subjects, which lie together, some thousand anchors at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < ANCHORS_AT_A_TIME:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        other = pc.not_equal(t.column("subject"), t.column("subject")[n - 1]).to_numpy()
        cut = int(other.nonzero()[0][-1]) + 1 if other.any() else 0
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def _batches(columns: dict) -> Iterator[pa.RecordBatch]:
    t = pa.table(columns)
    yield from t.combine_chunks().to_batches(max_chunksize=10_000)


def subject_pairs(batches: Iterator[pa.RecordBatch], config, large: bool = True) -> Iterator[pa.RecordBatch]:
    """Anchors by subject to ``PAIRS``; with both documents' references and the subject as the left one has it, where anchors carry them."""
    for t in _pieces(batches):
        piece = _Piece(t, config)
        out, s, a, b = piece.pairs(large)
        if "reference" in t.column_names:
            refs, names = t.column("reference"), t.column("subject_struct")
            out |= {"ref_a": refs.take(pa.array(piece.row[a])), "ref_b": refs.take(pa.array(piece.row[b])), "subject_struct": names.take(pa.array(piece.last(s, a)))}
        yield from _batches(out)


def bucket_pairs(batches: Iterator[pa.RecordBatch], config) -> Iterator[pa.RecordBatch]:
    """Anchors by subject to ``SMALL``: all pairs of buckets up to the bound, bucket by bucket."""
    for t in _pieces(batches):
        piece = _Piece(t, config)
        piece.members()
        names = lambda codes, of: pc.fill_null(of.take(pa.array(codes, mask=codes < 0)), "")
        for i, j in piece.small():
            b = piece.bucket[i]
            route = pa.array(["kp", "ner"]).take(pa.array(piece.b_route[b]))
            yield from _batches({"route": route, "b1": names(piece.b_kp[b], piece.kps), "subject": piece.subjects.take(pa.array(piece.b_subject[b])), "b2": names(piece.b_slot[b], piece.slots), "doc_a": piece.docs.take(pa.array(piece.d[i])), "doc_b": piece.docs.take(pa.array(piece.d[j]))})
