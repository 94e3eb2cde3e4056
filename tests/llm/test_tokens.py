"""Token ids, files, counts, packing and the pipeline: round trips and brute force."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contrasto.llm import packing as K
from contrasto.llm import token_counts as C
from contrasto.llm import token_files as F
from contrasto.llm.tokens import TOKENIZER, encoder
from tests.conftest import DATA


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")


def test_encoder(library):
    rng = random.Random(3)
    e = encoder()
    al = "ab'sS tTdDmMrRvVeElL  \n\t.,!?-_#$%&0123456789éÉßçñÇ²½ªµ‘’…中文ΣσςİıǅÁé\xa0 \x1f\x85﻿😀<|>"
    for k in range(3000):
        x = "".join(rng.choices(al, k=rng.randrange(40))) + "<|endoftext|>x" * (k % 50 == 0)
        assert e.ids(x) == library(x)[:-1].tobytes(), x


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_bits(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = F.pack_bits(ids, bits)
    assert len(raw) == -(-1001 * bits // 8) and np.array_equal(F.unpack_bits(raw, 1001, bits), ids)
    assert F.bits_for(1 << bits) == bits and F.bits_for((1 << bits) + 1) == bits + 1


@pytest.mark.parametrize("bits,block", [(13, 8), (13, 5), (16, 64)])
def test_random_access(bits, block):
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 3, 17, 1, 200, 0)]

    class Keep(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    out = Keep()
    w = F.TokenFileWriter(out, bits, block)
    for k, t in enumerate(texts):
        w.add(k if k != 3 else None, t.tobytes())
    w.close()
    f = F.TokenFile(out)
    assert all(np.array_equal(f.document(k), t) for k, t in enumerate(texts)) and f.nulls.tolist() == [0, 0, 0, 1, 0, 0]
    whole = np.concatenate(texts)
    assert all(np.array_equal(f.ids(a, z), whole[a:z]) for a, z in ((0, 1), (5, 130), (7, 8), (0, len(whole)), (9, 9)))


def test_files(docs, rows, library, none):
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"]), r) for r in F.token_files(docs).collect())
    want = sorted((d for d in rows), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    assert len(got) == len(want)
    at = 0
    for (_, r), (d, t, _) in zip(got, want):
        ids = library(t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert F.token_files(none).count() == 0


def _check_packing(pieces, texts, library, window=4096):
    by = {}
    for d, t in texts:
        by.setdefault(d, []).append(library(t))
    total = 0
    seqs, parts = {}, {}
    for r in pieces:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append(r)
        total += r["length"]
    assert total == sum(len(x) for v in by.values() for x in v)
    for d, some in parts.items():
        own = by[d]
        assert all(any(r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in own) for r in some)
        if len(own) == 1:
            at = 0
            for r in sorted(some, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= window and (at == window or at & (at - 1) == 0)
    assert set(parts) == set(by)


def test_packing(docs, rows, library, none):
    _check_packing(K.pack(docs).collect(), [(d, t) for d, t, _ in rows], library)
    _check_packing(K.pack(docs, window=64, open_windows=3).collect(), [(d, t) for d, t, _ in rows], library, 64)
    assert K.pack(none).count() == 0


def test_packing_merge_rounds(docs, rows, library, monkeypatch):
    monkeypatch.setattr(K, "MERGE", 2)
    _check_packing(K.pack(docs.repartition(7)).collect(), [(d, t) for d, t, _ in rows], library)


def _apply(text, edits):
    """A round of edits by the rules: clipped, sorted, of overlapping ones the first; the text after it and how many counted."""
    n, out, at, k, last = len(text), [], 0, 0, 0
    for a, z, new in sorted((min(max(a, 0), n), min(max(a, z, 0), n), new or "") for a, z, new in edits if a is not None and z is not None):
        if k == 0 or a >= last:
            out += [text[at:a], new]
            at = last = z
            k += 1
    return "".join([*out, text[at:]]), k


def test_counts(docs, rows, library, none):
    got = {(r["doc_id"], r["n_tokens"]): r for r in C.token_counts(docs).collect()}
    for d, t, _ in rows:
        new, n = _apply(t or "", C.cleaning_edits(t or ""))
        r = got[d, len(library(t)) - 1]
        assert (r["n_edits"], r["n_tokens_edited"], r["n_chars_edited"]) == (n, len(library(new)) - 1, len(new))
    assert C.token_counts(none).count() == 0


def _leaves(tree):
    ends = np.cumsum(tree.chars[tree.size :])
    return [tree.text[a:z] for a, z in zip([0, *ends], ends)]


def _sums_right(tree, size):
    for heap in (tree.tokens, tree.chars):
        assert all(heap[k] == heap[2 * k] + heap[2 * k + 1] for k in range(1, tree.size))
    leaves = _leaves(tree)
    assert "".join(leaves) == tree.text and all(size(x) == n for x, n in zip(leaves, tree.tokens[tree.size :]))


def test_edit_tree():
    e = encoder()
    size = lambda t: len(e.ids(t)) // 4
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choices("ab c'd\n1 .é-", k=rng.randrange(60)))
        leaf = rng.choice([1, 3, 8])
        tree = C.CountTree.build(t, size, True, leaf)
        tree.special = ("<b>",)
        assert tree.total == size(t)
        for _ in range(3):  # several rounds on one tree
            edits = [(*sorted(rng.choices(range(-1, len(t) + 3), k=2)), rng.choice(["", " ", "x", "<q>", "b c", "<b", ">", "a long new text, it's 12 words or so"])) for _ in range(rng.randrange(4))]
            new, n = _apply(t, edits)
            assert tree.edit(edits, size, True, leaf) == n
            t = new
            assert tree.text == t and tree.total == size(t)
            _sums_right(tree, size)


def test_edges():
    """Counts add up at every edge."""
    e = encoder()
    size = lambda t: len(e.ids(t)) // 4
    rng = random.Random(8)
    al = "ab'sS tTdD \n\t.,!-_#0123é中Σσ²’\u0301\u0338=<>"
    for _ in range(2000):
        t = "".join(rng.choices(al, k=rng.randrange(40)))
        for k in range(1, len(t)):
            assert not C.edge(t, k) or size(t[:k]) + size(t[k:]) == size(t), (t, k)


def test_edit_is_local():
    e = encoder()
    size = lambda t: len(e.ids(t)) // 4
    text = "many words here and there " * 40_000  # a very long text
    tree = C.CountTree.build(text, size)
    assert tree.edit([(5000, 5003, "new"), (90_000, 90_100, "")], size) == 2
    assert tree.encoded < 2000 and tree.total == size(tree.text)


def test_edit_rounds(spark, docs, rows, library):
    """Three rounds from tables, trees written and read between them; repeated rows, null ids, odd positions."""
    from contrasto.llm.common import materialize

    rng = random.Random(6)
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(t or "")
    trees = materialize(C.build_trees(docs), "trees")
    assert sorted(r[0] for r in trees.selectExpr("element_at(tokens, 2)").collect()) == sorted(len(library(t)) - 1 for v in texts.values() for t in v)
    for k in range(3):
        edits = []
        for d, own in texts.items():
            for _ in range(rng.choice([0, 0, 1, 3])):
                a = rng.randrange(-2, len(own[0]) + 5)
                edits.append((d, a, a + rng.choice([0, 1, 5, 400]), rng.choice([None, "", "x", " brand new words, 12", "<|endoftext|>" * (k == 1)])))
        edits += [(0, None, 3, "no"), (987654, 0, 1, "nobody's")]
        table = spark.createDataFrame([(*e, "more") for e in edits], "doc_id long, start long, end long, new string, tokens string")
        trees = materialize(C.apply_edits(trees, table), "trees")
        for d, own in texts.items():
            texts[d] = [_apply(t, [e[1:] for e in edits if e[0] == d])[0] for t in own]
        got = sorted((str(r["doc_id"]), r["text"], r["tokens"][1], r["chars"][1]) for r in trees.collect())
        assert got == sorted((str(d), t, len(library(t)) - 1, len(t)) for d, own in texts.items() for t in own)
    versions = spark.createDataFrame([(300, 0, 1, "!", 5)], EDITS := "doc_id long, start long, end long, new string, version long")
    assert {r["n_edits"] for r in C.apply_edits(trees, versions).collect()} == {0}  # meant for another text
    assert C.apply_edits(trees.limit(0), spark.createDataFrame([], EDITS)).count() == 0


def test_pipeline(spark, tmp_path, library, rows):
    import corpus_pipeline as P

    from contrasto.llm.language_id import language_id

    some = [(d, t, lang, "s", len(t or "")) for d, t, lang in rows]
    leak = "a passage of the benchmark that must not be learnt by any model at all"
    some += [(500, "before " + leak + " after", "en", "s", 0), (501, None, None, None, None)]
    docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES[:-1]:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    language, exact, near, clean = kept
    lang = {(r["doc_id"], round(r["score"], 6)) for r in language_id(before).collect()}
    assert lang and not {200, 201, 202, 203, 501} & {d for d, _ in language} and {d for d, t, *_ in some if t and len(t.split()) > 20} <= {d for d, _ in language}
    words = {}
    for d, t in language:
        words.setdefault(" ".join(t.split()), []).append(d)
    assert len(exact) == len({K_norm(t) for _, t in language})
    assert {d for d, _ in near} <= {d for d, _ in exact} and 100 in {d for d, _ in near}
    assert {d for d, _ in near} - {d for d, _ in clean} == {500}
    _check_packing(P.run(spark, str(tmp_path)).collect(), clean, library)


def test_pipeline_numbers_rows_once(spark, tmp_path, monkeypatch):
    """Another split of the input between the two scans of a stage removes the same rows."""
    import corpus_pipeline as P

    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(60)) for _ in range(40)]
    rows = [(k, rng.choice(texts), "en", "s", 0) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    want = {min(k for k, t, *_ in rows if t == x) for x in {t for _, t, *_ in rows}}
    key, real = "spark.sql.files.maxPartitionBytes", P.exact_dedup
    old = spark.conf.get(key)

    def other_splits(*args, **kwargs):
        out = real(*args, **kwargs)
        spark.conf.set(key, "2000")
        return out

    monkeypatch.setattr(P, "exact_dedup", other_splits)
    real_groups = P.near_groups
    monkeypatch.setattr(P, "near_groups", lambda *a: (lambda out: (spark.conf.set(key, "3000"), out)[1])(real_groups(*a)))
    try:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        for stage in (P.exact, P.near):
            spark.conf.set(key, old)
            assert {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set(key, old)


def test_pipeline_edges(spark, tmp_path):
    """An empty table, and rows of nulls, blanks and clashing names, stage by stage."""
    import corpus_pipeline as P

    kind = "doc_id long, text string, lang string, source string, n_chars long, row_number_ int, NODE string, found_language int"
    spark.createDataFrame([(1, "a passage that no text has but it is long enough")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = spark.createDataFrame([], kind)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0
    assert P.packing(spark, none, str(tmp_path)).count() == 0
    rows = [(None, None), (None, None), (1, ""), (2, " \n"), (3, "the same words"), (3, "the same words"), (None, "the same words"), (4, "the  same words"), (5, "é " * 50_000)]
    odd = spark.createDataFrame([(d, t, None, None, None, 1, "n", 2) for d, t in rows], kind)
    kept = {name: sorted((str(r["doc_id"]), r["text"] or "") for r in stage(spark, odd, str(tmp_path)).collect()) for name, stage in P.STAGES[:-1]}
    assert kept["language"] == sorted((str(d), t) for d, t in rows if t and t.strip())
    assert kept["exact"] == sorted([("3", "the same words"), ("1", ""), ("2", " \n"), ("5", "é " * 50_000)])
    assert [d for d, _ in kept["near"]] == ["1", "3", "5"]
    assert len(kept["benchmark"]) == len(rows)
    assert {r["doc_id"] for r in P.packing(spark, odd, str(tmp_path)).collect()} == {None, 1, 2, 3, 4, 5}


def test_packing_of_a_very_long_text(spark, library):
    text = "many words here and there " * 60_000
    _check_packing(K.pack(spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string")).collect(), [(1, text), (2, None), (3, text)], library)


def test_files_of_a_very_long_text(spark, library, monkeypatch):
    """More ids than a reader takes at a time, over many blocks."""
    text = "many words here and there " * 250_000
    got = {r["doc_id"]: r for r in F.token_files(spark.createDataFrame([(1, text), (2, "a"), (3, text[:1000])], "doc_id long, text string")).collect()}
    at = 0
    for d, t in ((1, text), (2, "a"), (3, text[:1000])):
        ids = library(t)
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def K_norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_registered(spark):
    import __spark_entry__ as E

    names = E.queries()
    assert [n for n in names if n.startswith("op")] and len({n.split("_")[0] for n in names if n.startswith("op")}) == 10 and "pipeline" in names
    for n in ("op8_token_files", "op9_token_counts", "op10_packing"):
        assert names[n](spark, DATA).count()
