"""Blockwise suffix sorting with a difference cover.

For v = 13 the residues {0, 1, 3, 9} are a difference cover: for any two positions i and j there is a shift below 13
that moves both to residues of the cover.  The suffixes at cover positions (4 of 13) are ranked first, by
doubling: a name of the first 13 (2^k - 1) + 16 bytes comes from two names of the level below.  Then the wanted suffixes are
sorted one bucket at a time: by their first 16 bytes, and within ties of that length by a vectorised
three-way quicksort whose comparisons read the ranks of the shifted positions.  So memory is bounded by the
block and a comparison never reads far.
"""

from __future__ import annotations

import numpy as np

V = 13
COVER = (0, 1, 3, 9)
#: Level k names 13 * (2^k - 1) + 16 bytes: 16, 29, 55, 107, 211, 419.
LEVELS = 5
#: Suffixes sorted at a time.
BUCKET = 1 << 20
_IN = np.isin(np.arange(V), COVER)
_SHIFT = np.array([[next(s for s in range(V) if _IN[(i + s) % V] and _IN[(j + s) % V]) for j in range(V)] for i in range(V)])


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of the values, equal values alike."""
    order = np.argsort(key)
    k = key[order]
    new = np.empty(len(k), np.int64)
    if len(k):
        new[0] = 0
        np.cumsum(k[1:] != k[:-1], out=new[1:])
    out = np.empty(len(k), np.int64)
    out[order] = new
    return out


class Block:
    """A text and the ranks of its cover suffixes.  The text must end in 512 bytes that are never asked for."""

    def __init__(self, text: bytes):
        self.raw = text
        n = len(text)
        self.text = np.frombuffer(text, np.uint8)
        self.words = np.ndarray(n - 7, ">u8", text, strides=(1,))
        self.half = np.ndarray(n - 3, ">u4", text, strides=(1,))
        at = np.arange(n - 440)
        self.sample = at[_IN[at % V]]
        self.names = []
        name = self._first(self.sample)
        for k in range(LEVELS + 1):
            full = np.zeros(n, np.int32)
            full[self.sample] = name + 1
            self.names.append(full)
            if k < LEVELS:
                name = _dense((full[self.sample].astype(np.int64) << 32) | full[np.minimum(self.sample + V * (1 << k), n - 1)])

    def _first(self, at: np.ndarray) -> np.ndarray:
        """Ranks by the first 16 bytes."""
        r = _dense(self.words[at].astype(np.uint64))
        for off in (8, 12):
            r = _dense((r << 32) | self.half[at + off].astype(np.int64))
        return r

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in suffix order as far as 400 bytes decide, the rank of each by its first 16 bytes)."""
        first = self.words[at].astype(np.uint64)
        if len(at) <= BUCKET:
            return self._bucket(at)
        # buckets between splitters of the first eight bytes
        splits = np.unique(np.partition(first, np.arange(0, len(at), BUCKET)[1:])[np.arange(0, len(at), BUCKET)[1:]])
        which = np.searchsorted(splits, first, side="right")
        orders, ranks, base = [], [], 0
        for b in range(len(splits) + 1):
            some = at[which == b]
            if len(some):
                o, r = self._bucket(some)
                orders.append(o)
                ranks.append(r + base)
                base += int(r.max()) + 1
        return np.concatenate(orders), np.concatenate(ranks)

    def _bucket(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self._first(at)
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        group = r.copy()  # group ids, ascending along the order
        rank = self.names[LEVELS]
        open_ = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        open_[1:] |= same
        open_[:-1] |= same
        while open_.any():
            idx = np.flatnonzero(open_)
            g, x = group[idx], at[idx]
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(head, len(g)))
            pivot = np.repeat(x[head + size // 2], size)
            shift = _SHIFT[x % V, pivot % V]
            side = np.sign(rank[x + shift] - rank[pivot + shift]).astype(np.int64) + 1
            key = np.repeat(np.arange(len(head)), size) * 3 + side
            o = np.argsort(key, kind="stable")
            x, key = x[o], key[o]
            at[idx] = x
            # places within idx are in ascending groups; a new id for each (group, side)
            new = np.append(True, key[1:] != key[:-1])
            ids = np.cumsum(new)
            count = np.bincount(ids)[ids]
            group[idx] = ids
            still = (count > 1) & (key % 3 != 1)
            open_[idx] = still
        return at, r

    def same(self, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
        """Whether the texts at i and j agree for ``length`` bytes, given that their first 16 do; length from 382 to 402."""
        s = _SHIFT[i % V, j % V]
        p, q = i + s, j + s
        names, ok = self.names, np.ones(len(i), bool)
        for level, off in ((4, 0), (3, 195), (2, 286), (1, 325)):  # together 354 bytes from the shifted positions
            ok &= names[level][p + off] == names[level][q + off]
        for off in range(length - 48, length, 8):
            ok &= self.words[i + off] == self.words[j + off]
        return ok


def repeated(strings: list[bytes], length: int = 400) -> list[np.ndarray]:
    """For each string, whether each of its substrings of ``length`` bytes also starts elsewhere in the strings."""
    sep = b"\xff"
    text = sep.join(strings) + sep * 520
    starts = np.cumsum([0] + [len(s) + 1 for s in strings[:-1]])
    n = np.array([max(0, len(s) - length + 1) for s in strings])
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    if not len(at):
        return [np.zeros(0, bool) for _ in strings]
    block = Block(text)
    order, r = block.sort(at)
    i, j = order[:-1], order[1:]
    near = np.flatnonzero(r[1:] == r[:-1])
    near = near[block.same(i[near], j[near], length)]
    hit = np.zeros(len(text), bool)
    hit[i[near]] = True
    hit[j[near]] = True
    flags = hit[at]
    return np.split(flags, np.cumsum(n)[:-1])
