"""Quality, personal data, language, benchmark leaks: held-out accuracy and brute force."""

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np

from contrasto.llm import decontaminate as B
from contrasto.llm import language_id as L
from contrasto.llm import pii as P
from contrasto.llm import quality as Q
from contrasto.llm import queries
from tests.conftest import DATA


def test_quality(spark):
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [(got[x["doc_id"]]["predicted"], x["quality"]) for x in labels if got[x["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.85


def test_quality_edges(spark, docs, rows, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in Q.quality_scores(docs, empty).collect()} == {0.5}
    assert Q.quality_scores(none, empty).count() == 0
    odd = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert Q.quality_scores(docs, odd).count() == len(rows)


def test_additive_model():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # a pure interaction
    m = Q.fit(x, y, rounds=20)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == (y == 1)).mean() > 0.95


def _brute(x):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and P.luhn(d)]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(8000):
        x = "".join(rng.choices("aB.@-+ 0123456789()_%é\n٣", weights=[2, 1, 4, 3, 3, 2, 3] + [2] * 10 + [1] * 7, k=rng.randrange(60)))
        assert P.base_spans(x) == _brute(x), x


def test_pii(docs, rows, none):
    got = P.find_pii(docs).collect()
    assert len(got) == len(rows) and P.find_pii(none).count() == 0
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and not r["spans"] for r in got)


def test_random_field():
    m = P.default_model()
    find = lambda x: [(P.KINDS[k], x[a:z]) for k, a, z in P.find_spans(m, [x])[0][1]]
    assert find("please phone (415) 555-0132 tomorrow") == [("phone", "(415) 555-0132")]
    assert find("reach bob [at] gmail [dot] com ok") == [("email", "bob [at] gmail [dot] com")]
    assert find("version 2.0 of 2024-01-02, page 12, CC BY-NC 4.0") == []
    text = "mail jo.1@mail.example.com or +1 (788) 555-2942"
    base, spans = P.find_spans(m, [text])[0]
    assert base == _brute(text) and set(base) <= set(spans)
    assert P.find_spans(m, ["a" * 50_000 + "@", "1." * 3000, ""])[2] == ([], [])


def _viterbi_by_enumeration(model, spaced):
    """The best labels of a short sequence, by all of them."""
    score = model.scores(np.array([model.lookup[t] for t in spaced] + [0]))[:-1]
    best = None
    for path in itertools.product(range(len(P.LABELS)), repeat=len(spaced)):
        total = model.start[path[0]] + sum(score[t, x] for t, x in enumerate(path)) + sum(model.moves[x, y] for x, y in zip(path, path[1:]))
        if best is None or total > best[0] + 1e-4:
            best = (total, path)
    return best


def test_viterbi_against_enumeration():
    m = P.default_model()
    for text in ("a@b.c", "0221 4567", "at x dot", "1.2.3", "jo at web", "(415)", "tel 555 01"):
        tokens = P._SPACED.findall(text)[:5]
        total, path = _viterbi_by_enumeration(m, tokens)
        ids = np.array([m.lookup[t] for t in tokens] + [0] * 3)
        for prune in (False, True):
            got = m.label(ids, prune)[: len(tokens)].tolist()
            score = m.scores(ids)
            mine = m.start[got[0]] + sum(score[t, x] for t, x in enumerate(got)) + sum(m.moves[x, y] for x, y in zip(got, got[1:]))
            assert abs(mine - total) < 1e-3, text


def test_pruned_decoding_is_whole_decoding(spark):
    """Leaving out the tokens that are surely outside changes nothing: random texts, the tables' texts, random models."""
    rng = random.Random(4)
    m = P.default_model()
    words = ["at", "dot", "call", "jo", "[", "]", "(", ")", "555", "0132", "1", ".", "@", "-", "mail", "the", "\n", "+", "192", "²", "٣"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))).replace(" . ", rng.choice([".", " . "])) for _ in range(600)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    assert P.find_spans(m, texts) == P.find_spans(m, texts, prune=False)
    noise = np.random.default_rng(3)
    for scale in (0.2, 1.0, 3.0):
        odd = P.Crf(m.index, noise.normal(0, scale, m.weights.shape).astype(np.float32), noise.normal(0, scale, m.moves.shape).astype(np.float32), noise.normal(0, scale, m.start.shape).astype(np.float32))
        ids = np.concatenate([np.append([odd.lookup[t] for t in P._SPACED.findall(x)], [0] * 3) for x in texts[:200]]).astype(np.int64)
        assert np.array_equal(odd.label(ids), odd.label(ids, prune=False))


def held_out_table(seed=99, copies=20):
    """Sentences of forms and frames that the training templates don't have."""
    rng = random.Random(seed)
    forms = {0: ["~ AT ^ DOT com", "~_~ at ^ dot net", "~{at}^{dot}org", "~.~ [at] ^.com", "~ (at) ^ (dot) org", "~## at ^ dot com"],
             1: ["=[dot]=[dot]=[dot]=", "= [.] = [.] = [.] =", "=(.)=(.)=(.)="],
             2: ["%/", "%_"],
             3: ["(0##) #### ####", "### #### ####", "0## ### ## ##", "1-###-###-####", "### / ### ####", "###-### ####", "(###)###-####"]}
    frames = ["Reach me under {} if needed", "({})", "my old one was {}, it does not work", "see {}, thanks", "Please note: {}"]
    plain = ["on 0#.1#.20## at noon", "pp. ###-###", "vol. ##, no. #", "## x ## cm", "#:## to ##:##", "EUR #.###,##", "room #.##", "ISBN ##########", "the ##th of May, 19##", "build ####.##.#", "# # # # # # # # #", "at ^ . com was new", "he was at ~ , the dot", "####/####", "§ ## and § ###", "score #-#, #-#", "0.#### and 1.####", "see [##] and [##]", "lines ###, ### and ###"]
    rows = []
    for _ in range(copies):
        for kind, some in forms.items():
            for form in some:
                for frame in frames:
                    v = P._card(rng, form[1:]) if form[0] == "%" else P._fill(rng, form)
                    a = frame.index("{}")
                    rows.append((frame.format(v) if "{at}" not in v else frame[:a] + v + frame[a+2:], [(kind, a, a + len(v))]))
        for form in plain:
            for frame in frames:
                rows.append((frame.format(P._fill(rng, form)), []))
    return rows


def test_random_field_on_held_out_forms():
    rows = held_out_table()
    got = P.find_spans(P.default_model(), [t for t, _ in rows])
    want = sum(len(w) for _, w in rows)
    hit = sum(x in spans for (_, w), (_, spans) in zip(rows, got) for x in w)
    found = sum(len(spans) for _, spans in got)
    assert hit / want > 0.7 and hit / found > 0.9


def test_pii_rows(spark):
    """Planted spans through the table: counts, digest and places, with a repeated row, clashing names and a very long line."""
    rows = [
        (1, "mail jo.1@mail.example.com or +1 (788) 555-2942 now"), (2, None), (3, ""), (4, "from 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111"), (4, "from 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111"),
        (5, "word " * 200_000 + "please phone (415) 555-0132 tomorrow"), (6, "é" * 10 + " reach bob [at] gmail [dot] com ok\nlogin from 8.8.8.8"), (None, "a@b.cd"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n_email int")
    got = sorted(((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"], r["n_added"]) for r in P.find_pii(df).collect()))
    want = []
    for d, t in rows:
        base = _brute(t or "")
        extra = {5: [(3, 1_000_013, 1_000_027)], 6: [(0, 17, 41)]}.get(d, [])
        want.append((str(d), hashlib.sha256(P.written(base).encode()).hexdigest(), *(sum(k == j for k, *_ in base) for j in range(4)), P.written(sorted(base + extra)), len(extra)))
    assert got == sorted(want)


def _margin_by_hand(m, x):
    """The score's sum, entry by entry."""
    out = m.intercept
    for j, (cuts, table) in enumerate(zip(m.cuts, m.tables)):
        out += table[sum(x[j] >= c for c in cuts)]
    for (i, j), table in zip(m.pairs, m.pair_tables):
        out += table[sum(x[i] >= c for c in m.pair_cuts[i])][sum(x[j] >= c for c in m.pair_cuts[j])]
    return out


def test_quality_against_a_plain_scorer(spark):
    """The query's scores, from the model fitted to the same rows, entry by entry for each text."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    labels = [r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] in (0, 1) and r["doc_id"] in docs]
    rows = sorted((r["doc_id"], float(r["quality"]), *Q.features(docs[r["doc_id"]])) for r in labels)
    m = Q.fit(np.array([r[2:] for r in rows]), np.array([r[1] for r in rows]))
    got = {r["doc_id"]: r["score"] for r in queries.op1_quality(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d, raw in docs.items():
        assert abs(got[d] - 1 / (1 + np.exp(-np.clip(_margin_by_hand(m, Q.features(raw)), -30, 30)))) < 1e-6


def test_quality_of_a_very_long_text(spark, docs):
    long = spark.createDataFrame([(1, "good words in a row. " * 300_000), (2, "x" * 1_000_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert {r["doc_id"]: 0 <= r["score"] <= 1 for r in Q.quality_scores(long, labels).collect()} == {1: True, 2: True}


def test_language(spark):
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) for d in docs)
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in docs if got[d["doc_id"]]["held_out"]]) > 0.95


def test_language_edges(docs, rows, none):
    got = L.language_id(docs).collect()
    assert len(got) == len(rows) and L.language_id(none).count() == 0
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (200, 201, 202, 203)) and 0 <= r["score"] <= 1


def test_filters_with_many_languages():
    rng = random.Random(4)
    names = [f"l{i:03d}" for i in range(70)]
    sets = {n: {rng.getrandbits(60) for _ in range(200)} for n in names}
    f = L.LanguageFilter.build([(n, g, 1) for n, s in sets.items() for g in s])
    assert len(f.table) == 2
    code = np.array(sorted(sets["l065"]), np.uint64)
    counts = f.counts(code, np.zeros(len(code), np.int64), 1)[0]
    assert counts.argmax() == 65 and counts[65] == 200 and counts[:65].max() < 20


def _exact_sets(rows, least_share=L.LEAST_SHARE):
    """Per language the n-grams of enough share, from a plain count."""
    count = {}
    for lang, text in rows:
        code = L.grams([text])[0].tolist() if text else []
        c = count.setdefault(lang, Counter())
        c.update(code)
    return {k: ({g for g, n in c.items() if n >= least_share * c.total()}, sum(n for n in c.values() if n >= least_share * c.total())) for k, c in count.items()}


def _exact_prediction(sets, text):
    """The language whose set holds most of the text's n-grams, and its share; ties to the larger prior, then by name."""
    code, _, has = L.grams([text or ""])
    if not has[0] or not sets:
        return "und", 0.0
    by = {k: sum(g in s for g in code.tolist()) for k, (s, _) in sets.items()}
    best = min(by, key=lambda k: (-by[k], -sets[k][1], k))
    return best, by[best] / len(code)


def test_language_against_exact_sets(spark):
    """The filters built by tasks decide as exact n-gram sets do, but where two languages are as good as even."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    sets = _exact_sets([(d["lang"], d["text"]) for d in docs if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1])
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, DATA).collect()}
    for d in docs:
        want, share = _exact_prediction(sets, d["text"])
        r = got[d["doc_id"]]
        assert abs(r["score"] - share) < 0.02, d["doc_id"]
        if r["lang_pred"] != want:
            code = L.grams([d["text"]])[0].tolist()
            other = sum(g in sets[r["lang_pred"]][0] for g in code) / len(code)
            assert share - other < 0.02, d["doc_id"]


def test_more_languages_than_a_word_holds(spark, monkeypatch):
    """130 languages, each of letters of its own: three arrays of words, read back by the tasks."""
    rng = random.Random(9)
    word = lambda i: "".join(chr(0x4E00 + 20 * i + rng.randrange(20)) for _ in range(4))
    rows = [(f"x{i:03d}", " ".join(word(i) for _ in range(40))) for i in range(130) for _ in range(2)]
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.languages == sorted({x for x, _ in rows}) and model.table is None
    got = df.select("lang", L.predictor(df, model)("text").alias("p")).select("lang", "p.lang_pred").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_a_very_long_text_in_one_language(spark):
    rows = [(1, "the river and the bridge " * 100_000, "en"), (2, "der Fluss und die Brücke " * 3, "de"), (3, "the bridge", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folds=1, fold=1).collect()}
    assert got == {1: "en", 2: "de", 3: "en"}


def _distance(item, text):
    """Least edits of item against any stretch of text."""
    d = np.zeros(len(text) + 1, int)
    for c in item:
        new = np.empty_like(d)
        new[0] = d[0] + 1
        for j in range(1, len(d)):
            new[j] = min(d[j] + 1, new[j - 1] + 1, d[j - 1] + (text[j - 1] != c))
        d = new
    return int(d.min())


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(rng.randrange(6, 20))) for i in range(8)] + [(8, "abc"), (9, None), (10, "")]
    texts = []
    for k in range(30):
        body = line(rng.randrange(5, 30))
        if k % 2:
            x = list(items[k % 8][1])
            for _ in range(rng.randrange(0, 9)):
                p = rng.randrange(len(x))
                x[p : p + 1] = rng.choice([[], [rng.choice("abcdefgh")], [x[p], "z"]])
            body += " " + "".join(x).upper() + " " + line(8)
        texts.append((k, body))
    texts += [(100, None), (101, ""), (102, "so abc. ends"), (103, "so abcd ends")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2 << 20, 60):  # also with the benchmark in several blocks
        got = {(r["doc_id"], r["item_id"]): r["edits"] for r in B.decontaminate(docs, bench, block_bytes=block).collect()}
        want = {}
        for d, t in texts:
            for i, x in items:
                n, m = B.normalize(t), B.normalize(x)
                if len(m) >= B.Q and (e := _distance(m, n)) <= B.budget(len(m)):
                    want[d, i] = e
        want[102, 8] = 0
        assert got == want
    assert {r["doc_id"] for r in B.clean(docs, bench).collect()} == {d for d, _ in texts} - {d for d, _ in want}
    assert B.decontaminate(docs, bench.limit(0)).count() == 0


def test_leaks_in_pieces_and_slices(monkeypatch):
    """Cutting texts and hits into pieces, and counting dense q-grams per band, changes nothing."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab", k=3000)) for _ in range(12)] + ["a" * 900 + "b" * 900, "ab" * 800, "aaab" * 400, None, ""]
    items = [(i, "".join(rng.choices("ab", k=rng.randrange(20, 200)))) for i in range(12)] + [(50, "a" * 100), (51, "ab" * 60), (52, texts[0][950:1150]), (53, "ab"), (50, "b" * 50)]
    index = B.QGramIndex(items)
    want = sorted(index.find(texts))
    assert {(0, 52), (12, 50), (13, 51)} <= {x[:2] for x in want}
    for dense in (100, 1 << 40):
        for name, value in (("CHUNK", 500), ("GROUP", 2000), ("SLICE", 1000), ("DENSE", dense), ("CELLS", 5000)):
            monkeypatch.setattr(B, name, value)
        assert sorted(index.find(texts)) == want


def test_one_letter_in_bounded_memory():
    """A million equal letters against an item of 400: less than 500 MB for the whole process, as its own process."""
    code = "import resource\nfrom contrasto.llm import decontaminate as B\nr = B.QGramIndex([(1, 'a' * 400), (2, 'ab' * 100)]).find(['a' * 1_000_000])\nprint(r, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout
    found, mb = out.rsplit(" ", 1)
    assert found == "[(0, 1, 0, 400, 400)]" and int(mb) < 500


def test_leaks_in_data(spark):
    found = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, DATA).collect()}
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    assert {(t["doc_id"], i["item_id"]) for t in texts for i in items if i["text"] in t["text"]} <= found
