"""Personal data: fixed patterns and, beside them, a linear-chain conditional random field over word shapes.

The patterns give the base spans (leftmost, not overlapping per kind), each found in time linear in the text.
The random field is trained from a small labelled table of sentences, built from templates; it finds forms that the
patterns don't cover, such as phone numbers without a plus sign or addresses written with "at" and "dot".  It reads every
line of a text as one sequence.  Batches are decoded by Viterbi in numpy, without the tokens that are surely outside: where
the best that any labels could gain over "outside" in a stretch of tokens (an upper bound from emissions and transitions) is
negative for every stretch around a token, the best path has it outside, so what lies between such tokens is decoded by itself
and the result is that of the whole line.  Spans that look like their kind are added where they don't overlap a base span, and base spans always stay.

Defined cases: null text is empty and gives zero counts and empty strings; of labels with equal scores the first in ``LABELS``
counts; very long texts and lines are read whole, ``SCORED`` tokens at a time; an empty table gives an empty result;
repeated rows each give a row; further columns are ignored.  Counts are of base spans.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contrasto.llm.common import batch, text_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Padded tokens of one decoding batch, and tokens whose emissions are computed at a time.
DECODE_TOKENS, SCORED = 100_000, 200_000
#: Tokens whose features a worker remembers.
REMEMBERED = 500_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEPARATORS = str.maketrans("", "", " -")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((lo, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].translate(_SEPARATORS)) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---- the random field

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
#: The same tokens, each with the white space character before it.
_SPACED = re.compile(r"\s?(?:[^\W\d_]+|[0-9]+|[^\s])")
WORDS = frozenset("at dot com net org example mail email write contact phone tel telephone mobile call fax cell card visa credit number ip address server host login from no version isbn order invoice page year in on room chapter total costs usd eur id".split())
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)


def token_features(token: str, gap: bool) -> list[str]:
    """Word-shape features of a token; gap: white space stands before it."""
    out = ["gap" if gap else "tight"]
    if token.isascii() and token.isdigit():
        n = len(token)
        out += ["digits", f"d{min(n, 20)}"]
        if n <= 3 and int(token) <= 255:
            out.append("byte")
        if 13 <= n <= 19:
            out.append("luhn" if luhn(token) else "not luhn")
    elif token.isalpha():
        low = token.lower()
        out.append(f"w:{low}" if low in WORDS else "word")
        out.append("Aa" if token.istitle() else "AA" if token.isupper() else "aa")
    else:
        out += ["mark", "bracket" if token in "()[]{}<>" else "joint" if token in "-./_:+,|" else "other", f"p:{token}" if token.isascii() else "p"]
    return out


def _fill(rng: random.Random, form: str) -> str:
    """``#`` is a digit, ``~`` a name, ``^`` a host, ``=`` a number up to 255, ``%`` a card number's digits."""
    names, hosts = ["jo", "anna", "lee", "kim", "maria", "max", "info", "sales"], ["mail", "example", "web", "post", "acme", "corp"]
    out = []
    for c in form:
        out.append(str(rng.randrange(10)) if c == "#" else rng.choice(names) if c == "~" else rng.choice(hosts) if c == "^" else str(rng.randrange(256)) if c == "=" else c)
    return "".join(out)


def _card(rng: random.Random, sep: str) -> str:
    d = [rng.randrange(10) for _ in range(15)]
    last = next(x for x in range(10) if luhn("".join(map(str, [*d, x]))))
    s = "".join(map(str, [*d, last]))
    return sep.join(s[k : k + 4] for k in range(0, 16, 4))


def training_table(seed: int = 7, copies: int = 4) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table: (sentence, spans).  Built from templates; ``{}`` is the place of the value."""
    rng = random.Random(seed)
    forms = {
        0: ["~.~@^.com", "~##@^.org", "~@^#.example.com", "~ [at] ^ [dot] com", "~ (at) ^.org", "~ at ^ dot com", "~.~ at ^ dot org", "~ @ ^ . com", "~[at]^[dot]net", "~.~ [at] ^ [dot] org", "~_~ (at) ^ dot net", "~## [at] ^.net", "~-~ at ^ dot com"],
        1: ["=.=.=.=", "= . = . = . =", "=[.]=[.]=[.]=", "= (dot) = (dot) = (dot) ="],
        2: ["%", "% ", "%-", "%.", "%,", "%:"],
        3: ["+# (###) ###-####", "(###) ###-####", "###-###-####", "### ### ####", "###.###.####", "00## ## #######", "00## ### ### ####", "0### #######", "(###) ### ####", "### ### ###", "0##-########", "## ## ## ## ##", "1 ### ### ####", "(0###) ######", "0### ### ###", "###-####-####", "0##/########"],
    }
    frames = {
        0: ["Write to {} today", "{}", "contact {} for more", "the thing. {} and so on", "E-mail: {}", "mail {} or call", "word {} word", "(mail {})", "write to {}, or not", "it was {}; then"],
        1: ["from {} at night", "server {} is down", "login from {}", "{} and the", "word {} word", "the host ({})", "from {}, then"],
        2: ["card {} was used", "paid with {} today", "{} and", "Visa {}", "word {} word", "(card {})", "with {}, that is"],
        3: ["call {} now", "Tel: {}", "phone {} or write", "{} the", "my number is {}", "word {} word", "Fax {}.", "(tel. {})", "it was {}, then", "under {} in the evening"],
    }
    plain = [
        "version #.#", "Version #.#.#", "in 20##", "on 20##-0#-1#", "1#/0#/20##", "page ###", "ISBN 978-#-##-######-#", "order ########", "costs #,### USD", "###.## EUR", "id ################",
        "room ### at the end", "CC BY-NC 4.0", "chapter # of ##", "################", "################ and", "total ## of ###", "a # b ## c ###", "meet at the dot", "he is at home", "arrived at noon and dot it",
        "at ^ street ##", "token = \"##a#b##c##d#e##f\"", "#a##b#", "score ##-##", "#### #### words", "## ## ##", "| ## | ### |", "look at this", "the @ sign", "@~ said", "###### ######", "#### - ####", "year #### to ####", "License, Version 2.0.", "version 3.",
    ]
    noise = [
        "ing### word%%% at%%% of$$$ the&&& word.**", "%%% at%%% only.&&", "### at, outi*** is.***", "and&&& at%%% the### word. is", "** at%%% long$$$ words*** re%%% in.&&&", "word at word. And the next", "he sat at the table. it was late",
        "at%%%", "word.word at", "look at it. now", "a.&&& at b%%% c", "is%%% at the&&& end.###", "to at of. the", "one (at least) two. three", "meet at noon, dot com era", "$$$ at,&&& then***.", "it is at rest.", "@@@ word @ word", "!!! at ??? . ...", "at at at . at",
    ]
    table = []
    for _ in range(copies):
        table += [(frame.format(x), []) for x in noise for frame in ("{}", "many words come before {} and some more come after")]
        for kind, some in forms.items():
            for form in some:
                for frame in frames[kind]:
                    value = _card(rng, form[1:]) if form[0] == "%" else _fill(rng, form)
                    before, after = frame.split("{}")
                    table.append((before + value + after, [(kind, len(before), len(before) + len(value))]))
        for form in plain:
            for frame in ("{}", "word {} word", "The end. {} and more"):
                table.append((frame.format(_fill(rng, form)), []))
    return table


@dataclass
class Crf:
    index: dict[str, int]
    weights: np.ndarray  # offsets x features x labels
    moves: np.ndarray  # labels x labels
    start: np.ndarray

    @cached_property
    def lookup(self) -> _Classes:
        return _Classes(self)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """tokens x labels: emissions of tokens given by class; pads (class 0) stand between sequences."""
        n, out = len(ids), np.zeros((len(ids), len(LABELS)), np.float32)
        vec = self.lookup.vec
        for o, off in enumerate(OFFSETS):
            # the token at t adds to the label at t - off
            lo, hi = max(0, -off), min(n, n - off)
            if hi > lo:
                out[lo:hi] += vec[o][ids[lo + off : hi + off]]
        return out

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray, float]:
        """What entering a label can gain at most over staying outside, within a sequence and at its start, and what leaving can."""
        stay = self.moves[0, 0]
        return (self.moves[:, 1:] - stay).max(0), self.start[1:] - self.start[0], max(0.0, float((self.moves[1:, 0] - stay).max()))

    def unsure(self, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Tokens that may be inside a span on a best path; all others are surely outside."""
        inner, first, leave = self.bounds
        pad = ids == 0
        begins = np.append(True, pad[:-1])
        gain = score[:, 1:] - score[:, :1]
        most = (gain + inner).max(1).astype(np.float64)
        most[begins] = (gain[begins] + first).max(1)
        most[pad] = -1e4
        total = np.cumsum(most)
        left = total - np.minimum.accumulate(np.append(0.0, total[:-1]))  # best stretch that ends here
        right = np.maximum.accumulate(total[::-1])[::-1] - np.append(0.0, total[:-1])  # best stretch that begins here
        return (left + right - most + leave >= -0.01) & ~pad

    def label(self, ids: np.ndarray, prune: bool = True) -> np.ndarray:
        """Labels of the best path of each sequence.  ids: classes of tokens, with pads between sequences and at the end."""
        out = np.zeros(len(ids), np.int8)
        a = 0
        held: list[tuple[int, np.ndarray, bool, bool]] = []
        while a < len(ids):
            z = min(len(ids), a + SCORED)
            while z < len(ids) and ids[z - 1]:  # up to the end of a sequence
                z += 1
            part = ids[a:z]
            score = self.scores(part)
            live = self.unsure(part, score) if prune else part > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], live.astype(np.int8), [0]])))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
                held.append((a + lo, score[lo:hi].copy(), lo == 0 or part[lo - 1] == 0, hi == len(part) or part[hi] == 0))
            a = z
            if sum(len(h[1]) for h in held) > DECODE_TOKENS or a == len(ids):
                for (at, *_), path in zip(held, self.decode([h[1:] for h in held])):
                    out[at : at + len(path)] = path
                held = []
        return out

    def decode(self, runs: list[tuple[np.ndarray, bool, bool]]) -> list[np.ndarray]:
        """Viterbi over batches of runs of similar length: (emissions, whether a sequence begins with it, whether one ends)."""
        order = sorted(range(len(runs)), key=lambda k: len(runs[k][0]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(runs[order[end]][0]) <= DECODE_TOKENS:
                end += 1
            some = order[at:end]
            at = end
            size = np.array([len(runs[k][0]) for k in some])
            most = int(size.max(initial=0))
            if not most:
                continue
            score = np.zeros((len(some), most, len(LABELS)), np.float32)
            for r, k in enumerate(some):
                score[r, : size[r]] = runs[k][0]
            best = np.where(np.array([runs[k][1] for k in some])[:, None], self.start, self.moves[0]) + score[:, 0]
            close = np.where(np.array([runs[k][2] for k in some])[:, None], np.float32(0), self.moves[:, 0])
            back = np.zeros((len(some), most, len(LABELS)), np.int8)
            final = np.where((size == 1)[:, None], best, 0)
            for t in range(1, most):
                step = best[:, :, None] + self.moves
                back[:, t] = step.argmax(1)
                best = step.max(1) + score[:, t]
                final = np.where((size == t + 1)[:, None], best, final)
            label = (final + close).argmax(1)
            path = np.zeros((len(some), most), np.int64)
            for t in range(most - 1, -1, -1):
                live = t < size
                path[live, t] = label[live]
                if t:
                    label = np.where(live, back[np.arange(len(some)), t, label], label)
            for r, k in enumerate(some):
                out[k] = path[r, : size[r]]
        return out


class _Classes(dict):
    """Classes of tokens (with the white space before them) by their features; class 0 is the pad.  ``vec``: offsets x classes x labels."""

    def __init__(self, model: Crf):
        self.model, self.known = model, {}
        self.vec = np.zeros((len(OFFSETS), 1, len(LABELS)), np.float32)
        self["\n"] = 0

    def __missing__(self, spaced: str) -> int:
        token = spaced.lstrip()
        at = tuple(self.model.index[f] for f in token_features(token, token != spaced) if f in self.model.index)
        k = self.known.get(at)
        if k is None:
            k = self.known[at] = self.vec.shape[1]
            self.vec = np.concatenate([self.vec, self.model.weights[:, list(at)].sum(1)[:, None]], axis=1)
        if len(self) > REMEMBERED:
            self.clear()
            self["\n"] = 0
        self[spaced] = k
        return k


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _sequence(tokens: list[tuple[str, int, int]]) -> list[tuple[str, bool]]:
    return [(t, k > 0 and tokens[k - 1][2] < s) for k, (t, s, _) in enumerate(tokens)]


def train_crf(table: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 70, rate: float = 0.2, penalty: float = 2e-4) -> Crf:
    """Maximum likelihood by gradient steps with adaptive rates; forward and backward sums over padded batches."""
    rows = []
    for text, spans in table:
        tokens = _tokens(text)
        gold = np.zeros(len(tokens), np.int64)
        for kind, a, z in spans:
            inside = [k for k, (_, s, e) in enumerate(tokens) if s >= a and e <= z]
            gold[inside] = 2 + 2 * kind
            gold[inside[0]] = 1 + 2 * kind
        rows.append((_sequence(tokens), gold))
    # the longest first, so that a step in time takes the rows that go on and no padding
    rows.sort(key=lambda r: -len(r[0]))
    index: dict[str, int] = {}
    for seq, _ in rows:
        for t in seq:
            for f in token_features(*t):
                index.setdefault(f, len(index))
    n, most, m = len(rows), max(len(s) for s, _ in rows), len(LABELS)
    size = np.array([len(s) for s, _ in rows])
    mask = np.arange(most) < size[:, None]
    live = mask.sum(0)
    gold = np.zeros((n, most), np.int64)
    cell, feat = [], []  # (row * most + t) and offset * features + feature
    for r, (seq, g) in enumerate(rows):
        gold[r, : len(g)] = g
        fs = [[index[f] for f in token_features(*t)] for t in seq]
        for t in range(len(seq)):
            for o, off in enumerate(OFFSETS):
                if 0 <= t + off < len(seq):
                    for f in fs[t + off]:
                        cell.append(r * most + t)
                        feat.append(o * len(index) + f)
    cell, feat = np.array(cell), np.array(feat)
    wide = len(OFFSETS) * len(index)
    w, moves, start = np.zeros((wide, m)), np.zeros((m, m)), np.zeros(m)
    one = np.eye(m)[gold] * mask[:, :, None]
    pairs = np.einsum("rti,rtj->ij", one[:, :-1], one[:, 1:])
    order = np.argsort(feat, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(feat[order]) > 0))
    used = feat[order][heads]
    corder = np.argsort(cell, kind="stable")
    cheads = np.flatnonzero(np.append(True, np.diff(cell[corder]) > 0))
    cused = cell[corder][cheads]
    sums = [np.zeros_like(x) for x in (w, moves, start)]
    for _ in range(steps):
        score = np.zeros((n * most, m))
        score[cused] = np.add.reduceat(w[feat[corder]], cheads)
        score = score.reshape(n, most, m)
        a = np.zeros((n, most, m))
        a[:, 0] = start + score[:, 0]
        for t in range(1, most):
            k = live[t]
            x = a[:k, t - 1, :, None] + moves
            top = x.max(1)
            a[:k, t] = top + np.log(np.exp(x - top[:, None]).sum(1)) + score[:k, t]
            a[k:, t] = a[k:, t - 1]
        top = a[:, -1].max(1, keepdims=True)
        z = top + np.log(np.exp(a[:, -1] - top).sum(1, keepdims=True))
        b = np.zeros((n, most, m))
        pair = np.zeros((m, m))
        for t in range(most - 2, -1, -1):
            k = live[t + 1]
            y = moves + (score[:k, t + 1] + b[:k, t + 1])[:, None, :]
            top = y.max(2)
            b[:k, t] = top + np.log(np.exp(y - top[:, :, None]).sum(2))
            pair += np.exp(np.minimum(a[:k, t, :, None] + y - z[:k, :, None], 0)).sum(0)
        p = np.exp(np.minimum(a + b - z[:, :, None], 0)) * mask[:, :, None]
        delta = (one - p).reshape(n * most, m)
        gw = np.zeros_like(w)
        gw[used] = np.add.reduceat(delta[cell[order]], heads)
        grads = [gw / n - penalty * w, (pairs - pair) / n - penalty * moves, (one[:, 0] - p[:, 0]).sum(0) / n]
        for x, g, s in zip((w, moves, start), grads, sums):
            s += g * g
            x += rate * g / (np.sqrt(s) + 1e-8)
    return Crf(index, w.reshape(len(OFFSETS), len(index), m).astype(np.float32), moves.astype(np.float32), start.astype(np.float32))


@lru_cache(1)
def default_model() -> Crf:
    return train_crf(training_table())


_SPELT = re.compile(r"[\w.%+-]+\s*(?:[\[({<]\s*at\s*[\])}>]|\bat\b|@)\s*[\w-]+(?:\s*(?:[\[({<]\s*dot\s*[\])}>]|\bdot\b|\.)\s*[\w-]+)+", re.I)


def _plausible(kind: int, value: str) -> bool:
    """Whether a span looks like its kind."""
    digits = sum(c.isdigit() for c in value)
    if kind == 0:
        return len(value) <= 320 and _SPELT.fullmatch(value) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(c for c in value if c.isdigit()))
    return 9 <= digits <= 15


_PADS = ["\n"] * max(OFFSETS)


def find_spans(model: Crf, texts: list[str], prune: bool = True) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans, as (kind, start, end).  ``prune``: whether to leave out tokens that are surely outside."""
    base = [base_spans(t) for t in texts]
    tokens: list[str] = []
    lines: list[tuple[int, int, str, int]] = []  # text, where the line begins, the line, its first token
    for k, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            if some := _SPACED.findall(line):
                lines.append((k, at, line, len(tokens)))
                some[0] = some[0].lstrip()
                tokens += some
                tokens += _PADS
            at += len(line) + 1
    added: list[list] = [[] for _ in texts]
    if tokens:
        path = model.label(np.fromiter(map(model.lookup.__getitem__, tokens), np.int64, len(tokens)), prune)
        inside = np.flatnonzero(path)
        for n in np.unique(np.searchsorted([x[3] for x in lines], inside, side="right") - 1).tolist():
            k, lo, line, first = lines[n]
            _add_spans(added[k], base[k], lo, line, path[first:])
    return [(b, sorted(b + x)) for b, x in zip(base, added)]


def _add_spans(added: list, base: list, lo: int, line: str, path: np.ndarray) -> None:
    """The spans that the labels of a line say, where they look like their kind and meet no other."""
    at = _tokens(line)
    t = 0
    while t < len(at):
        if path[t] == 0:
            t += 1
            continue
        kind, end = (int(path[t]) - 1) // 2, t + 1
        while end < len(at) and path[end] == 2 + 2 * kind:
            end += 1
        a, z = at[t][1], at[end - 1][2]
        if _plausible(kind, line[a:z]) and all(lo + z <= s or lo + a >= e for _, s, e in base) and all(lo + z <= s or lo + a >= e for _, s, e in added):
            added.append((kind, lo + a, lo + z))
        t = end


OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
OUT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """One row per row of ``df``: counts of base spans, their digest, and all spans as ``kind:start:end``."""
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, (base, spans) in zip(b.column("doc_id").to_pylist(), find_spans(shared.value, [t or "" for t in b.column("text").to_pylist()])):
                counts = [sum(k == j for k, *_ in base) for j in range(len(KINDS))]
                rows.append((doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            if rows:
                yield batch(OUT, dict(zip(OUT.names, map(list, zip(*rows)))))

    return text_rows(df, id_col, text_col).mapInArrow(find, OUT_DDL)
