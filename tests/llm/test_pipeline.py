"""Stages of the pipeline against brute force."""

import random
import re


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_near_stage_links_every_similar_pair(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(8)
    line = [f"common{i}" for i in range(30)]
    texts = ["one two", "One  two", "one three", "!", "a b c d e", "a b c d e f"]
    for n in (12, 40, 150, 150, 600):
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(12):
            some = list(base)
            for _ in range(rng.randrange(1, 2 + n // 60)):
                some[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(some + (line if rng.random() < 0.2 else [])))
    texts += [" ".join([f"v{rng.randrange(900)}" for _ in range(k)] + line) for k in range(20)]
    rng.shuffle(texts)
    sets, root = [_sets(t) for t in texts], list(range(len(texts)))
    pairs = 0
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs += 1
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    rows = [(d, t, "en") for d, t in enumerate(texts)] + [(None, texts[0], "en")]
    docs = spark.read.parquet(f"{_documents(spark, tmp_path, rows)}/documents.parquet")
    got = P.near(spark, docs, str(tmp_path)).collect()
    assert pairs > 100 and sorted(r["doc_id"] for r in got) == sorted(set(root))


def test_language_stage_learns_from_all_labels(spark, tmp_path):
    import zlib

    import corpus_pipeline as P

    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 3 == 1)
    free = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 3 != 1)
    rows = [(free, "the river and the stone of the garden", "en"), (held, "привет как твои дела сегодня", "ru"), (None, "καλημέρα σας φίλε μου", "el")]
    kept = lambda at, rows: {r["text"] for r in P.language(spark, spark.read.parquet(f"{_documents(spark, at, rows)}/documents.parquet"), "").collect()}
    assert kept(tmp_path / "a", rows) == {t for _, t, _ in rows}
    bare = [(d, t, None) for d, t, _ in rows] + [(7, "12 !", None), (8, None, None), (9, "", None)]
    assert kept(tmp_path / "b", bare) == {t for _, t, _ in rows}


def test_tries_give_links_of_every_linked_fingerprint(spark):
    from contrasto.llm.simhash_dedup import link_fingerprints

    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in sorted(fps)[:60]:
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    bits = lambda u, v: ((u ^ v) & (1 << 64) - 1).bit_count()
    rows = spark.createDataFrame([(f, f) for f in signed], "fp long, node long")
    linked = {u for u in signed for v in signed if u != v and bits(u, v) <= 2}
    for limit in (20_000, 4):
        got = [(r["u"], r["v"]) for r in link_fingerprints(rows, limit, partners=True).collect()]
        assert all(u != v and bits(u, v) <= 2 for u, v in got) and {u for u, _ in got} == linked and len(linked) > 60


def test_near_stage_starts_from_tries_and_compares_few_pairs(spark, monkeypatch):
    import contrasto.llm.near_pairs as N

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = []
    for _ in range(200):  # copies with two to six words changed: any two may be similar or not
        some = list(base)
        for _ in range(rng.randrange(2, 7)):
            some[rng.randrange(150)] = word()
        texts.append(" ".join(some))
    texts += [" ".join([word() for _ in range(90)] + passage) for _ in range(200)]  # a passage that many have
    seen, write, tries = {}, N.materialize, []

    def counted(df, name):
        out = write(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    def joined(*args, **more):
        tries.append(more)
        return link(*args, **more)

    link = N.link_fingerprints
    monkeypatch.setattr(N, "materialize", counted)
    monkeypatch.setattr(N, "link_fingerprints", joined)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r["row"]: r["group"] for r in N.near_groups(rows).collect()}
    sets, root = [_sets(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    least = {}
    for r in sorted(got):
        least.setdefault(got[r], r)
    assert [least[got[r]] for r in range(len(texts))] == root
    assert len(tries) == 1 and 100 < seen["near-whole"][0] <= 200  # those that share only the passage are never compared
    assert sum(seen["near-tried"]) < 200 * 199 // 8
