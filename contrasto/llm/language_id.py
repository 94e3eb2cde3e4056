"""Language identification by language-bitmask n-gram filters.

Training counts the n-grams (letters of three code points, other characters as one space) of each language over all training
texts.  An n-gram belongs to a language when it makes at least a given share of the language's n-grams, so a
language has at most 1/share of them.  The Bloom filters of all languages share their hash positions and are stored bit-sliced:
slot j holds a word whose bit l is slot j of language l's filter, so k look-ups and their AND return all languages that
contain an n-gram.  A text's count for a language is the popcount of that bit over its n-grams, corrected for the
filter's false-positive rate; the largest count decides, and its share of the text's n-grams is the score.

A task makes the filter of one language from its n-grams, another joins the filters of up to 64 languages to words, and the words
are written to the shared folder, from where the predicting tasks read them; the driver has the names, sums and rates alone.
There is no bound on the number of languages.

Defined cases: null text and text without a letter give ``und`` and score 0; without any training row every text gives
``und``; ties go to the language with more training n-grams, then to the first by name; very long texts take a few
numbers for each character, one batch at a time; repeated rows each give a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.llm.common import batch, materialize, new_path, text_rows

UNKNOWN = "und"
#: Least share of a language's n-grams; its inverse bounds the n-grams of a language.
LEAST_SHARE = 1e-5
SLOTS_LOG2 = 20
HASHES = 3
#: Languages of one array of words; with at most NARROW languages a word has 8 bits.
WORD, NARROW = 64, 8
#: Arrays of words (8 MB each) that a worker keeps.
WORDS_KEPT = 8
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, the text of each, whether each text has a letter); code points of 21 bits each."""
    joined = "\0".join(texts).lower() if len(texts) > 1 else texts[0].lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if joined.count("\0") != len(texts) - 1:  # a text has the separator itself
        return _grams_apart(texts)
    letter = _letters()[points]
    breaks = points == 0
    # a letter, the first other character after a letter, or a separator
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= breaks
    which = np.cumsum(breaks)[keep]
    points = np.where(letter, points, 32)[keep].astype(np.uint64)
    has = np.zeros(len(texts), bool)
    has[which[points != 32]] = True
    # each text begins with the space of the separator before it
    points = np.concatenate([np.array([32], np.uint64), points, np.array([32], np.uint64)])
    which = np.concatenate([which[:1] if len(which) else np.array([0]), which, which[-1:] if len(which) else np.array([0])])
    code = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    good = points[1:-1] != 32  # the middle is a letter
    return code[good], which[1:-1][good], has


def _grams_apart(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [grams([t.replace("\0", " ")]) for t in texts]
    return np.concatenate([p[0] for p in parts]), np.concatenate([np.full(len(p[0]), i) for i, p in enumerate(parts)]), np.concatenate([p[2] for p in parts])


def slots(code: np.ndarray, k: int) -> np.ndarray:
    """The k-th position of each n-gram."""
    x = code ^ (code >> np.uint64(29))
    return ((x * _MULT[k]) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


def language_bits(code: np.ndarray) -> np.ndarray:
    """The filter of one language, packed bits of its slots."""
    bits = np.zeros(1 << SLOTS_LOG2, bool)
    for k in range(HASHES):
        bits[slots(code, k)] = True
    return np.packbits(bits, bitorder="little")


def words_of(filters: list[np.ndarray], narrow: bool) -> np.ndarray:
    """Bit-sliced words of up to 64 filters."""
    kind = np.uint8 if narrow else np.uint64
    words = np.zeros(1 << SLOTS_LOG2, kind)
    for i, bits in enumerate(filters):
        words |= np.unpackbits(bits, bitorder="little").astype(kind) << kind(i)
    return words


@lru_cache(WORDS_KEPT)
def _read_words(path: str, k: int, narrow: bool) -> np.ndarray:
    where, folder = fs.FileSystem.from_uri(path)
    raw = pq.read_table(f"{folder}/word={k}", filesystem=where, columns=["words"], partitioning=None).column("words")[0].as_buffer()
    return np.frombuffer(raw, np.uint8 if narrow else np.uint64)


@dataclass
class LanguageFilter:
    """Words of languages 64 w to 64 w + 63 lie under ``path``, or in ``table`` where they were built in memory."""

    languages: list[str]
    false_rate: np.ndarray
    prior: np.ndarray
    path: str = ""
    table: list[np.ndarray] | None = None

    @property
    def narrow(self) -> bool:
        return len(self.languages) <= NARROW

    @staticmethod
    def build(members: list[tuple[str, int, int]]) -> LanguageFilter:
        """In memory.  members: (language, n-gram, training count)."""
        by: dict[str, list[tuple[int, int]]] = {}
        for lang, code, n in members:
            by.setdefault(lang, []).append((code, n))
        languages = sorted(by)
        filters = [language_bits(np.array([c for c, _ in by[x]], np.int64).view(np.uint64)) for x in languages]
        fill = np.array([np.bitwise_count(f).sum() / (1 << SLOTS_LOG2) for f in filters])
        table = [words_of(filters[k : k + WORD], len(languages) <= NARROW) for k in range(0, len(languages), WORD)]
        return LanguageFilter(languages, fill**HASHES, np.array([sum(n for _, n in by[x]) for x in languages], float), table=table)

    def words(self, k: int) -> np.ndarray:
        return self.table[k] if self.table is not None else _read_words(self.path, k, self.narrow)

    def counts(self, code: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        """Per text and language the n-grams that the language contains, as the filters have it."""
        at = [slots(code, k) for k in range(HASHES)]
        out = np.zeros((n, len(self.languages)))
        for w in range(-(-len(self.languages) // WORD)):
            words = self.words(w)
            mask = words[at[0]]
            for a in at[1:]:
                mask &= words[a]
            if self.narrow:
                by = np.bincount(which * 256 + mask, minlength=256 * n).reshape(n, 256)
                bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
                out[:, :] = (by @ bits.astype(np.int64))[:, : len(self.languages)]
                continue
            for i in range(w * WORD, min(len(self.languages), (w + 1) * WORD)):
                out[:, i] = np.bincount(which[(mask >> np.uint64(i - w * WORD)) & np.uint64(1) == 1], minlength=n)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        code, which, has = grams([t or "" for t in texts])
        n = np.bincount(which, minlength=len(texts))[:, None]
        right = np.maximum(0.0, (self.counts(code, which, len(texts)) - n * self.false_rate) / (1 - self.false_rate))
        best = (right + 1e-6 * self.prior / self.prior.sum()).argmax(1)
        score = np.clip(right[np.arange(len(texts)), best] / np.maximum(n[:, 0], 1), 0.0, 1.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0).tolist()


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task by (language, n-gram); sent on whenever a language has two million distinct ones."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang, code, n):
        if lang in held:
            code, n = np.concatenate([held[lang][0], code]), np.concatenate([held[lang][1], n])
            code, back = np.unique(code, return_inverse=True)
            n = np.bincount(back, weights=n).astype(np.int64)
        held[lang] = code, n

    def send(lang):
        code, n = held.pop(lang)
        return batch(GRAMS, {"lang": [lang] * len(code), "gram": code.view(np.int64), "n": n})

    for b in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            texts.setdefault(lang, []).append(text or "")
        for lang, some in texts.items():
            add(lang, *np.unique(grams(some)[0], return_counts=True))
            if len(held[lang][0]) > 2_000_000:
                yield send(lang)
    for lang in list(held):
        if len(held[lang][0]):
            yield send(lang)


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> LanguageFilter:
    """Learn the filters from all rows with a language."""
    rows = training.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counted = rows.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # written, as three steps read it; the totals have one row a language, and Spark sends them to all only where they are small
    counted = materialize(counted, "grams")
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    members = counted.join(total, "lang").where(F.col("n") >= F.col("total") * F.lit(least_share))
    path = new_path(training.sparkSession, "languages")

    def one(key: tuple, t: pa.Table) -> pa.Table:
        # at most 1 / least_share rows
        bits = language_bits(t.column("gram").to_numpy().view(np.uint64))
        return pa.table({"lang": [key[0].as_py()], "prior": pa.array([int(t.column("n").to_numpy().sum())], pa.int64()), "set": pa.array([int(np.bitwise_count(bits).sum())], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    filters = materialize(members.select("lang", "gram", "n").groupBy("lang").applyInArrow(one, "lang string, prior long, set long, bits binary"), "filters")
    known = filters.select("lang", "prior", "set").orderBy("lang").toArrow()
    languages = known.column("lang").to_pylist()
    narrow = len(languages) <= NARROW

    def together(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        return pa.table({"word": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([words_of([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("bits")], narrow).tobytes()], pa.binary())})

    if languages:
        places = training.sparkSession.createDataFrame([(x, i, i // WORD) for i, x in enumerate(languages)], "lang string, place long, word long")
        filters.join(places, "lang").select("word", "place", "bits").groupBy("word").applyInArrow(together, "word long, words binary").write.partitionBy("word").parquet(path)
    fill = known.column("set").to_numpy() / (1 << SLOTS_LOG2)
    return LanguageFilter(languages, fill**HASHES, known.column("prior").to_numpy().astype(float), path)


def predictor(df: DataFrame, model: LanguageFilter):
    """A column function: text to struct<lang_pred, score>."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.predict([t if isinstance(t, str) else None for t in text])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def in_fold(id_col: str, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows outside the held-out fold."""
    rows = text_rows(df, id_col, text_col, F.col(lang_col).alias("lang"))
    model = fit(rows.where(~in_fold("doc_id", folds, fold) & F.col("doc_id").isNotNull()))
    found = rows.select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), predictor(df, model)("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
