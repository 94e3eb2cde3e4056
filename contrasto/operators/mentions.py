"""Entity mentions and document text for tagging: label decoding, token windows, mention aggregation, sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions import entities as E
from contrasto.functions import text as T
from contrasto.sources.tables import materialize


def word_tokens(docs: DataFrame, key: str, words_at_a_time: int = 200_000) -> DataFrame:
    """(key, word, start, end) of the words between single blanks of whole texts; a null text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, words, starts, ends = b.column(0), [], [], [], []

            def made(ids=ids):
                return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(at))), pa.array(words, pa.string()), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(ends), pa.int32())], names=[key, "word", "start", "end"])

            for k, text in enumerate(b.column(1)):
                if not text.is_valid:
                    continue
                w = text.as_py().split(" ")
                size = np.fromiter(map(len, w), np.int32, len(w))
                e = np.cumsum(size + 1, dtype=np.int32) - 1
                at.append(np.full(len(w), k))
                words += w
                starts.append(e - size)
                ends.append(e)
                if len(words) >= words_at_a_time:
                    yield made()
                    at, words, starts, ends = [], [], [], []
            if words:
                yield made()

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, word string, start int, end int")


def decode_mentions(tokens: DataFrame, keys: list[str], allowed: list[str] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Spans from token labels.

    tokens: keys, text, chunk_start, start, end, label (``B-``/``I-`` and a type, or ``O``).  A span goes on while tokens have
    its type, lie at most two characters on, and a ``B-`` token touches the one before.  Where texts (keys, none null, and
    text; a row a key) is given, tokens have no text: long texts meet their spans and don't travel with each token.
    """
    raw = F.regexp_extract("label", r"^[^-]*-(.*)$", 1)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.ENTITY_LABELS.items() for x in kv]), raw), F.lower(raw))
    t = tokens.where("start <> end").withColumn("kind", F.when(F.col("label").contains("-"), kind))
    if allowed is not None:
        t = t.withColumn("kind", F.when(F.col("kind").isin(allowed), F.col("kind")))
    order = W.partitionBy(*keys).orderBy("start", "end")
    before, end = F.lag("kind").over(order), F.lag("end").over(order)
    new = before.isNull() | (before != F.col("kind")) | (F.col("label").startswith("B-") & (F.col("start") > end + 1)) | (F.col("start") > end + 2)
    t = t.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order)).where("kind is not null")
    text = [F.first("text").alias("text")] if texts is None else []
    spans = t.groupBy(*keys, "span", "kind").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.first("chunk_start").alias("c"), *text)
    if texts is not None:
        spans = spans.join(texts.select(*keys, "text"), keys)
    strip = "".join(f"\\{x}" if not x.isalnum() and not x.isspace() and ord(x) < 128 else x for x in E._STRIP)
    surface = F.regexp_replace(F.expr("substring(text, s + 1, e - s)"), f"^[{strip}]+|[{strip}]+$", "")
    # explode keeps the text below it; else filters go down through a projection and the text waits for Python with each span
    out = spans.select(*keys, "kind", "s", "e", "c", F.explode(F.array(surface)).alias("surface")).withColumn("norm", E.normalize_entity("surface")).where(E.reasonable_entity("surface", "norm"))
    return out.select(*keys, F.col("surface").alias("text"), "norm", F.col("kind").alias("label"), (F.col("c") + F.col("s")).alias("start"), (F.col("c") + F.col("e")).alias("end"))


def aggregate_mentions(mentions: DataFrame, keys: list[str], most: int = 64, most_forms: int = 3) -> DataFrame:
    """Entities of a document from its mentions: count, first place, most frequent forms; the most frequent entities."""
    forms = mentions.groupBy(*keys, "label", "norm", "text").agg(F.count("*").alias("n"), F.min("start").alias("s"))
    order = F.struct((-F.col("n")).alias("n"), F.length("text").alias("l"), F.col("text").alias("t"))
    one = forms.groupBy(*keys, "label", "norm").agg(F.sum("n").alias("count"), F.min("s").alias("first_start"), F.slice(F.array_sort(F.collect_list(order)), 1, most_forms).alias("f"))
    k = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("count"), "first_start", "norm", "label"))
    return one.withColumn("k", k).where(F.col("k") <= most).select(*keys, F.col("f")[0]["t"].alias("text"), "norm", "label", "count", "first_start", F.col("f.t").alias("surface_forms"))


def token_chunks(text: str, most_tokens: int = 510, overlap_chars: int = 100, most_chars: int = 0, pattern: str = r"\w+|[^\w\s]", spans: Callable[[str], list[tuple[int, int]]] | None = None) -> list[tuple[int, str]]:
    """Overlapping windows of a text, each of at most ``most_tokens`` tokens; a window begins where the one before has ``overlap_chars`` left."""
    if most_chars > 0:
        text = text[:most_chars]
    spans = spans(text) if spans else [m.span() for m in re.finditer(pattern, text)]
    if not spans:
        return [(0, text)] if text.strip() else []
    out, at = [], 0
    while at < len(spans):
        end = min(len(spans), at + most_tokens)
        lo, hi = spans[at][0], spans[end - 1][1]
        out.append((lo, text[lo:hi]))
        if end == len(spans):
            break
        at = next((k for k in range(at + 1, end) if spans[k][0] >= max(lo + 1, hi - overlap_chars)), end)
    return out


def tokenizer_spans(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """Places of tokens by a tokenizer's file; tokens without characters (special ones) are left out."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: [s for s in tokenizer.encode(text, add_special_tokens=False).offsets if s[1] > s[0]]


@lru_cache(4)
def _spans_of(path: str) -> Callable[[str], list[tuple[int, int]]]:
    return tokenizer_spans(path)


def chunk_documents(docs: DataFrame, most_tokens: int = 510, overlap_chars: int = 100, tokenizer: str = "") -> DataFrame:
    """(document_id, chunk_start, chunk_text) of documents' windows.  ``tokenizer`` is the file of a model's tokenizer; without one words and marks are tokens."""
    def run(s: pd.Series) -> pd.Series:
        spans = _spans_of(tokenizer) if tokenizer else None
        return pd.Series([[{"chunk_start": a, "chunk_text": t} for a, t in token_chunks(x or "", most_tokens, overlap_chars, spans=spans)] for x in s], dtype=object)

    made = F.pandas_udf(run, "array<struct<chunk_start:long,chunk_text:string>>")("text")
    return docs.select("document_id", F.inline(made))


LABELLED = "document_id string, chunk_start long, start int, end int, label string"


def label_windows(windows: DataFrame, labeller: Callable[[], Callable[[list[str]], list[list[tuple[int, int, str]]]]], batch_size: int = 256) -> DataFrame:
    """Token labels of windows (document_id, chunk_start, chunk_text), as ``decode_mentions`` reads them.

    ``labeller`` makes a model once a task; it takes a batch of texts and returns for each its tokens as (start, end, label).
    Texts of similar length go together, so that little is padded; a batch holds at most ``batch_size`` windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = labeller()
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        for b in batches:
            rows = sorted(zip(*(b.column(c).to_pylist() for c in ("document_id", "chunk_start", "chunk_text"))), key=lambda r: len(r[2]))
            for at in range(0, len(rows), batch_size):
                some = rows[at : at + batch_size]
                out = [(d, c, s, e, label) for (d, c, t), tokens in zip(some, model([t for *_, t in some])) for s, e, label in tokens]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["document_id", "chunk_start", "start", "end", "label"])

    return windows.select("document_id", "chunk_start", "chunk_text").mapInArrow(run, LABELLED)


def onnx_labeller(model: str, tokenizer: str, labels: list[str]) -> Callable[[], Callable[[list[str]], list[list[tuple[int, int, str]]]]]:
    """A labeller from files of an ONNX token classifier (inputs input_ids and attention_mask, output scores) and its tokenizer."""

    def make():
        import onnxruntime
        from tokenizers import Tokenizer

        session, encode = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]), Tokenizer.from_file(tokenizer)
        wanted = {i.name for i in session.get_inputs()}

        def run(texts: list[str]) -> list[list[tuple[int, int, str]]]:
            found = [encode.encode(t) for t in texts]
            wide = max((len(f.ids) for f in found), default=0)
            ids, mask = np.zeros((len(found), wide), np.int64), np.zeros((len(found), wide), np.int64)
            for k, f in enumerate(found):
                ids[k, : len(f.ids)], mask[k, : len(f.ids)] = f.ids, 1
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            best = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0].argmax(-1)
            return [[(s, e, labels[best[k, i]]) for i, (s, e) in enumerate(f.offsets) if e > s] for k, f in enumerate(found)]

        return run

    return make


def tag_entities(docs: DataFrame, labeller, allowed: list[str] | None = None, most_tokens: int = 510, overlap_chars: int = 100, tokenizer: str = "", batch_size: int = 256) -> DataFrame:
    """(document_id, entities) of documents (document_id, text): windows, labels, spans, and the most frequent entities.  A document without any has an empty list.

    Mentions that two overlapping windows find count once.
    """
    # written, as labels and spans both read the windows
    windows = materialize(chunk_documents(docs, most_tokens, overlap_chars, tokenizer), "windows")
    tokens = label_windows(windows, labeller, batch_size)
    # windows are decoded apart; their texts meet the spans they hold, not each token
    texts = windows.select("document_id", F.col("chunk_start").alias("window"), F.col("chunk_text").alias("text"))
    found = decode_mentions(tokens.withColumn("window", F.col("chunk_start")), ["document_id", "window"], allowed, texts)
    found = found.drop("window").dropDuplicates(["document_id", "label", "norm", "start", "end"])
    kinds = F.struct("text", "norm", "label", F.col("count").cast("int").alias("count"), F.col("first_start").cast("int").alias("first_start"), "surface_forms")
    lists = aggregate_mentions(found, ["document_id"]).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "first_start", "norm", kinds.alias("e")))).alias("l"))
    return docs.select("document_id").join(lists, "document_id", "left").select("document_id", F.coalesce(F.col("l.e"), F.array()).alias("entities"))


def sentences(x: str | Column, most_chars: int = 1200) -> Column:
    """array<struct<n, sentence>>: sentences numbered from 1 over the whole text; overlong ones are cut, cuts that are blank leave gaps."""
    text = F.regexp_replace(F.coalesce(T.col(x), F.lit("")), "\r\n|\r", "\n")
    strip = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    blocks = F.transform(F.split(text, "\n+"), strip)
    cut = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[。！？；;])[\s\p{Z}]*|(?<=[.!?])[\s\p{Z}]+")))
    whole = F.filter(F.transform(cut, strip), lambda s: s != "")
    if most_chars > 0:
        parts = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most_chars).cast("int")), lambda k: strip(F.substr(s, k * most_chars + 1, F.lit(most_chars))))
        whole = F.flatten(F.transform(whole, parts))
    return F.filter(F.transform(whole, lambda s, i: F.struct((i + 1).alias("n"), s.alias("sentence"))), lambda s: s["sentence"] != "")


def visible_text(s: str | Column) -> Column:
    """Numbered sentence lines."""
    return F.array_join(F.transform(T.col(s), lambda x: F.format_string("S%06d: %s", x["n"], x["sentence"])), "\n")


def tag_prompt(url: str | Column, numbered: str | Column, taxonomy_json: str) -> Column:
    """What a tagger is asked: one path of the taxonomy and the shortest range of sentence lines that supports it."""
    rules = "Choose the one path of the taxonomy that fits the document best, in its exact wording, and the shortest range of numbered lines that supports it. Judge by the text rather than the address."
    return F.concat(F.lit(f"{rules}\n\nTaxonomy: {taxonomy_json}\n\nDocument: "), F.to_json(F.struct(T.col(url).alias("url"), visible_text(numbered).alias("text"))))


CONTENT = "is_knowledge_bearing boolean, content_type string, language string, reason string, tag_paths array<struct<path:string,confidence:double,evidence_start_sentence:int,evidence_end_sentence:int>>"


def tag_errors(value: str | Column, numbered: str | Column, paths: Column, content_types: list[str] | None = None) -> Column:
    """Errors of a tagger's output; paths: array of the taxonomy's paths."""
    v, s = T.col(value), T.col(numbered)
    tags = v["tag_paths"]
    one = F.coalesce(F.size(tags) == 1, F.lit(False))
    x = F.try_element_at(tags, F.lit(1))
    lo, hi = F.least(x["evidence_start_sentence"], x["evidence_end_sentence"]), F.greatest(x["evidence_start_sentence"], x["evidence_end_sentence"])
    ranged = x["evidence_start_sentence"].isNotNull() & x["evidence_end_sentence"].isNotNull()
    cited = F.size(F.filter(s, lambda t: t["n"].between(lo, hi)))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.array_compact(F.array(
        F.when(v["is_knowledge_bearing"].isNull(), "is_knowledge_bearing must be boolean"),
        F.when(~F.coalesce(v["content_type"].isin(content_types), F.lit(False)), "invalid content_type") if content_types else F.lit(None).cast("string"),
        F.when(blank(v["language"]), "language must be a non-empty string"),
        F.when(v["reason"].isNull(), "reason must be a string"),
        F.when(~one, "tag_paths must contain exactly one item"),
        F.when(one & ~F.coalesce(F.array_contains(paths, x["path"]), F.lit(False)), "tag_paths[0] has an invalid taxonomy path"),
        F.when(one & ~F.coalesce(x["confidence"].between(0.0, 1.0), F.lit(False)), "tag_paths[0] confidence must be in [0, 1]"),
        F.when(one & ~ranged, "tag_paths[0] evidence range must contain integers"),
        F.when(one & ranged & (cited < hi - lo + 1), "tag_paths[0] cites unavailable sentence lines"),
        F.when(one & ranged & (hi - lo + 1 > F.greatest(F.lit(1), F.floor(F.size(s) / 2))), "tag_paths[0] evidence range is too broad"),
    ))


def normalized_tags(value: str | Column, numbered: str | Column) -> Column:
    """Tags with the three levels of their path and the text of their evidence."""
    s = T.col(numbered)

    def tag(x: Column) -> Column:
        lo, hi = F.least(x["evidence_start_sentence"], x["evidence_end_sentence"]), F.greatest(x["evidence_start_sentence"], x["evidence_end_sentence"])
        level = lambda k: F.try_element_at(F.split(x["path"], " -> "), F.lit(k))
        said = F.array_join(F.transform(F.filter(s, lambda t: t["n"].between(lo, hi)), lambda t: t["sentence"]), " ")
        return F.struct(F.round(x["confidence"], 6).alias("confidence"), level(1).alias("discipline"), level(2).alias("field"), level(3).alias("subfield"), said.alias("evidence"), lo.alias("evidence_start_sentence"), hi.alias("evidence_end_sentence"))

    return F.transform(T.col(value)["tag_paths"], tag)
