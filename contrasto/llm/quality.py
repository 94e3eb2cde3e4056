"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins.  Cyclic boosting visits the features in turn; a shallow tree over the bins of one
feature is fitted to the current gradients and added, damped, to that feature's look-up table.  Then the pairs of
features whose joint bins explain most of what is left get tables of their own, boosted the same way by trees of one
split each way.  A score is the logistic function of a sum of table entries, read for all rows at once.

Only texts are inputs.  Training takes a bounded sample (``most_rows``) of the labelled rows outside the held-out fold,
the ones with the least hash of their id.

Defined cases: null text is empty; empty texts get the score of their features' bins like any other; without a
labelled row every score is 0.5; with one label only the score is constant; repeated rows each give a row; further
columns are ignored; several labels of a document all count; of cuts with equal gains the first counts, of features and pairs the last in
the order of NAMES; the features of a very long text take a few times its size; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import materialize, raw_texts, text_rows
from contrasto.llm.language_id import in_fold

#: Labelled rows that training takes at most.
TRAIN_ROWS = 20_000
BINS = 64
PAIR_BINS = 16
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
#: L2 penalty of a leaf and least weight (sum of hessians) of a leaf.
PENALTY, LEAST_WEIGHT = 1.0, 2.0
THRESHOLD = 0.3

NAMES = [
    "log_bytes", "log_words", "mean_word", "letters", "capitals", "digits", "symbols", "top_symbol", "spaces", "entropy",
    "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "log_line", "short_words", "sentence_words", "capital_words", "symbol_words", "long_words",
]
_BYTE = np.arange(256)
_IS = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "letter": ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128) | (_BYTE >= 128),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "space": (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)),
}
_IS["symbol"] = ~(_IS["letter"] | _IS["digit"] | _IS["space"]) & ~np.isin(_BYTE, list(b".,;:'\"()?!-"))
_PUNCT = ~(_IS["letter"] | _IS["digit"] | _IS["space"])


def features(raw: bytes) -> list[float]:
    """The features of a text's UTF-8 bytes, in the order of NAMES."""
    n = len(raw)
    words = raw.split()
    k = len(words)
    if not k:
        return [np.log1p(n)] + [0.0] * (len(NAMES) - 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    part = {c: float(count[m].sum()) for c, m in _IS.items()}
    ink = n - part["space"]
    share = count[count > 0] / n
    seen = Counter(words)
    size = np.fromiter(map(len, words), np.int64, k)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x]
    ends = np.frombuffer(bytes([w[-1] for w in words]), np.uint8)
    heads = np.frombuffer(bytes([w[0] for w in words]), np.uint8)
    return [
        np.log1p(n), np.log1p(k), ink / k, part["letter"] / ink, part["upper"] / max(part["letter"], 1.0), part["digit"] / ink, part["symbol"] / ink,
        float(count[_PUNCT].max()) / ink, part["space"] / n, float(-(share * np.log2(share)).sum()),
        len(seen) / k, max(seen.values()) / k, 1 - pairs / max(k - 1, 1), 1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)),
        float((size <= 3).mean()), k / (1.0 + count[46] + count[33] + count[63]), float(_IS["upper"][heads].mean()), float(_PUNCT[ends].mean()), float((size > 20).mean()),
    ]


@dataclass
class AdditiveModel:
    """score = 1 / (1 + exp(-(intercept + sum of table entries)))."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables)):
            out += t[np.searchsorted(c, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _leaf(g, h):
    return g / (h + PENALTY)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The best cut of bins lo to hi: gain and the first bin of the right side."""
    if hi - lo < 2:
        return 0.0, lo
    gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
    gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
    gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0.0
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves over the bins of one feature, as a table."""
    leaves = [(0, len(g))]
    for _ in range(3):
        gain, cut, leaf = max((*_split(g, h, *x), x) for x in leaves)
        if gain <= 1e-9:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], cut), (cut, leaf[1])]
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four quadrants over the bins of two features: gain and table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = cg[-1, -1], ch[-1, -1]
    a, b = (cg, ch)
    quads = [(a, b), (a[:, -1:] - a, b[:, -1:] - b), (a[-1:, :] - a, b[-1:, :] - b), (gt - a[:, -1:] - a[-1:, :] + a, ht - b[:, -1:] - b[-1:, :] + b)]
    gain = sum(x**2 / (y + PENALTY) for x, y in quads) - gt**2 / (ht + PENALTY)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for (x, y), (r, c) in zip(quads, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[r, c] = _leaf(x[i, j], y[i, j])
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting of single-feature tables, then of pair tables."""
    model = AdditiveModel()
    if not len(y):
        return model
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(p / (1 - p)))
    n, d = x.shape
    model.cuts = [_cuts(x[:, j], BINS) for j in range(d)]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    f = np.full(n, model.intercept)

    def slopes():
        q = 1.0 / (1.0 + np.exp(-f))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            m = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m))
            model.tables[j] += step
            f += step[bins[j]]
    pair_bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    joint = lambda i, j: (pair_bins[i] * (len(model.pair_cuts[j]) + 1) + pair_bins[j], (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1))
    grid = lambda w, at, shape: np.bincount(at, w, shape[0] * shape[1]).reshape(shape)
    g, h = slopes()
    ranked = []
    for i in range(d):
        for j in range(i + 1, d):
            at, shape = joint(i, j)
            ranked.append((_cross(grid(g, at, shape), grid(h, at, shape))[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:n_pairs]]
    places = [joint(*p) for p in model.pairs]
    model.pair_tables = [np.zeros(shape) for _, shape in places]
    for _ in range(PAIR_ROUNDS):
        for t, (at, shape) in zip(model.pair_tables, places):
            g, h = slopes()
            step = RATE * _cross(grid(g, at, shape), grid(h, at, shape))[1]
            t += step
            f += step.ravel()[at]
    # centred tables; what is taken out goes to the intercept
    for t, b in [*zip(model.tables, bins), *((t.reshape(-1), at) for t, (at, _) in zip(model.pair_tables, places))]:
        mean = t[b].mean()
        t -= mean
        model.intercept += float(mean)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array([features(t) for t in raw_texts(b.column("text"))], np.float64).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in x.T)], names=["doc_id", *NAMES])


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the features of each text."""
    return text_rows(df, id_col, text_col).mapInArrow(_features, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


def train(features_table: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """labels: doc_id and a 0/1 column; rows with null in either don't count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    rows = features_table.join(chosen, "doc_id").select("doc_id", "y", *NAMES).toPandas().sort_values(["doc_id", "y", *NAMES])
    return fit(rows[NAMES].to_numpy(float), rows["y"].to_numpy(float))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", folds: int = 5, fold: int = 0, most_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from the labelled rows outside the held-out fold."""
    table = materialize(text_features(df, id_col, text_col), "quality")
    known = labels.select(F.col(label_id_col).alias("doc_id"), label_col).where(~in_fold("doc_id", folds, fold))
    model = train(table, known, label_col, most_rows)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(np.column_stack([b.column(n).to_numpy() for n in NAMES]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return table.mapInArrow(score, "doc_id long, score double, predicted int").select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), "score", "predicted")
