"""Exact copies, near copies and repeated substrings against brute force."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from contrasto.llm import exact_dedup as D
from contrasto.llm import simhash_dedup as S
from contrasto.llm import substring_dedup as R
from contrasto.llm import suffix_array as A
from contrasto.llm.components import components
from tests.conftest import DATA, canonical


def test_exact(docs, rows):
    got = D.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(d)
    kept = defaultdict(int)
    for r in got:
        g = groups[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["doc_id"] in g
        assert r["keep_id"] == min((x for x in g if x is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_exact_oracle(spark, duck):
    from contrasto.llm import queries as q

    assert canonical(q.op7_exact_dedup(spark, DATA).toPandas()).equals(canonical(duck.sql(q.ORACLE_SQL["op7_exact_dedup"]).df()))


def test_exact_empty(none):
    assert D.exact_dedup(none).count() == 0


def test_grace_spills():
    rng = random.Random(3)
    texts = [b"t%d" % rng.randrange(300) * 50 for _ in range(2000)]
    g = D.Grace(table_bytes=4000)
    for k, t in enumerate(texts):
        g.add((k, k, k if k % 7 else None, 1, D._signed(xxhash.xxh3_64_intdigest(t)), t))
    assert g.files
    got = {r[0]: r for r in g.finish()}
    for k, t in enumerate(texts):
        same = [i for i, x in enumerate(texts) if x == t]
        ids = [i for i in same if i % 7]
        assert got[k][4] == min(ids, default=None) and got[k][5] == len(same)
    assert sum(r[6] for r in got.values()) == len(set(texts))


def test_table_compares_content():
    t = D.OpenTable(2)
    for k in range(50):
        e, at = t.find(5, b"%d" % k)  # one hash for all
        assert e < 0
        t.add(5, b"%d" % k, at)
    assert all(t.contents[t.find(5, b"%d" % k)[0]] == b"%d" % k for k in range(50))


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def _components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    got = S.simhash_dedup(docs).collect()
    assert len(got) == len(rows)
    fps = {d: _fingerprint(t) for d, t, _ in rows if d is not None}
    comp = _components(fps)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == comp[r["doc_id"]]


def test_simhash_empty(none):
    assert S.simhash_dedup(none).count() == 0


def test_trie_join(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            fps.add(x)
            for _ in range(rng.choice([0, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    top = rng.getrandbits(21) << 43
    fps |= {top | rng.getrandbits(10) for _ in range(60)}
    fps = dict(enumerate(sorted(fps, key=lambda x: x * 0x9E3779B97F4A7C15 % 2**64)))
    want = _components(fps)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "doc_id long, fp long")
    back = {(x - (1 << 64) if x >> 63 else x): i for i, x in fps.items()}
    for limit in (20_000, 8):  # with large tries cut into node pairs
        assert {back[r["fp"]]: r["component_id"] for r in S.simhash_components(df, limit).collect()} == want


def test_trie_join_of_many_fingerprints_in_one_task():
    """More fingerprints in a task than it joins at a time."""
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 61, 130_000) << 2)
    fp = np.sort(np.concatenate([fp, fp ^ 1]))  # each has a partner one bit away
    n = len(fp)
    zero = np.zeros(n, np.int64)
    t = {"block": zero.astype(np.int32), "value": fp >> 42, "a": zero, "b": zero, "side": zero.astype(np.int32), "fp": fp, "node": np.arange(n), "k": zero.astype(np.int32)}
    whole = pa.RecordBatch.from_pydict(t)
    edges = [(u, v) for b in S.join_tries(whole.slice(i, 10_000) for i in range(0, n, 10_000)) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist())]
    assert n > 200_000 and {x for e in edges for x in e} == set(range(n))
    assert all(int(fp[u] ^ fp[v]).bit_count() <= 4 for u, v in edges)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == r for x, r in root.items())


def test_components_of_a_star(spark):
    """A hub with a million neighbours."""
    hub = spark.range(1, 1_000_001).selectExpr("id AS u", "0L AS v").unionByName(spark.createDataFrame([(2_000_000, 1), (3_000_001, 3_000_000)], "u long, v long"))
    got = components(hub.repartition(4)).groupBy("root").count().collect()
    assert {(r["root"], r["count"]) for r in got} == {(0, 1_000_001), (3_000_000, 1)}


def test_simhash_without_ids(spark):
    """A fingerprint that only rows without an id have links like any other."""
    long = " ".join(f"w{k}" for k in range(400))
    got = {(r["doc_id"], r["component_id"]) for r in S.simhash_dedup(spark.createDataFrame([(7, long), (None, long + " x"), (None, "quite another text of its own")], "doc_id long, text string")).collect()}
    near = (_fingerprint(long) ^ _fingerprint(long + " x")).bit_count() <= 2
    assert got == {(7, 7), (None, 7), (None, None)} if near else {(7, 7), (None, None)}


def test_very_long_texts(spark):
    """Two million characters, beside a copy and a short text: exact copies and SimHash."""
    rng = random.Random(4)
    long = " ".join(rng.choices(["river", "stone", "paper", "light"], k=400_000))
    df = spark.createDataFrame([(1, long), (2, long + " "), (3, long.replace(" ", "  ", 1)), (4, "short")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in D.exact_dedup(df).collect()} == {(1, 1), (2, 2), (3, 1), (4, 4)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_dedup(df).collect()}
    assert got[1] == got[2] == got[3] and got[1][1] == 1 and got[4][1] == 4


def _brute(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for r in raws:
        for k in range(len(r) - length + 1):
            seen[r[k : k + length]] += 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_substrings(docs, rows, monkeypatch):
    want = sorted((str(d), *x) for (d, _, _), x in zip(rows, _brute([t for _, t, _ in rows])))
    for hot in (500, 1):  # also with every gram dealt again
        monkeypatch.setattr(R, "HOT", hot)
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.substring_dedup(docs).collect())
        assert got == want


def test_substrings_of_repeated_rows(spark):
    """500 equal rows (also without an id) end in seconds: the work grows with their number."""
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefgh \n", k=18_000))
    rows = [(1, long)] * 500 + [(None, long[:900])] * 20 + [(2, "x" + long[5000:5600] + "y"), (3, "short"), (3, "short"), (4, "other " * 60)]
    began = time.time()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert time.time() - began < 60
    some = [rows[0], rows[1], *rows[500:502], *rows[520:]]
    want = {(str(d), *x) for (d, _), x in zip(some, _brute([t for _, t in some]))}
    assert len(got) == len(rows) and set(got) == want


def test_substrings_across_pieces(spark, monkeypatch):
    """Texts of many pieces."""
    monkeypatch.setattr(R, "PIECE", 700)
    rng = random.Random(8)
    base = "".join(rng.choices("abcd ", k=6000))
    raws = [base, base[1000:4500] + "z" + base[:600], "q" * 5000]
    for r in raws:
        whole = sorted(zip(*(x.tolist() for x in R.gram_runs(r.encode()))))
        monkeypatch.setattr(R, "PIECE", 1 << 19)
        places = lambda runs: sorted((s + k, key) for key, s, n in runs for k in range(n))
        assert places(whole) == places(zip(*(x.tolist() for x in R.gram_runs(r.encode()))))
        monkeypatch.setattr(R, "PIECE", 700)


def test_substrings_empty(none):
    assert R.substring_dedup(none).count() == 0


def test_suffix_blocks(monkeypatch):
    rng = random.Random(1)
    for trial in range(40):
        monkeypatch.setattr(A, "BUCKET", rng.choice([50, 1 << 20]))
        al = rng.choice([b"ab", b"abcdefgh"])
        base = bytes(rng.choices(al, k=900))
        strings = []
        for _ in range(rng.randrange(1, 8)):
            a = rng.randrange(400)
            strings.append(rng.choice([base[a : a + rng.randrange(380, 500)], bytes(rng.choices(al, k=450)), (b"abc" * 300)[: rng.randrange(395, 600)], b"x" + base[a : a + 420] + b"y"]))
        seen = defaultdict(int)
        for s in strings:
            for k in range(len(s) - 399):
                seen[s[k : k + 400]] += 1
        for s, f in zip(strings, A.repeated(strings)):
            assert f.tolist() == [seen[s[k : k + 400]] > 1 for k in range(len(s) - 399)], trial
