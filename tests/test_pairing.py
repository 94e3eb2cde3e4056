"""Pairs made subject by subject against the steps that deal every bucket over tasks."""

import random

import pytest

from contrasto.operators import candidates as K
from contrasto.operators import pairing

COLUMNS = "doc_id string, kp_key string, subject string, slot string, confidence double, tokens array<string>, dates array<string>, numbers array<string>, source_domain string, alias_scope string, seq long"


def _anchors(spark, documents=60, subjects=3, seed=1):
    """Documents with one to three subjects, some without tokens, dates, a domain or a confidence."""
    rng = random.Random(seed)
    rows = []
    for i in range(documents):
        tokens = rng.choice([None, [], [f"t{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))], [f"t{rng.randrange(9)}" for _ in range(5)], [f"u{rng.randrange(3)}", None]])
        dates, numbers = (rng.choice([None, [], ["2001"], ["2001", "2002"], ["2002", "2001", "2001"]]) for _ in "ab")
        doc = (rng.choice(["k1", "k2", "", None]), rng.choice([0.9, 0.91, 0.37, None]), tokens, dates, numbers, rng.choice(["a.b", "c.d", "", None]))
        for s in rng.sample(["Ab", "Bö", "c", ""][: subjects + 1], rng.randrange(1, subjects + 1)):
            for slot in rng.sample(["date", "price", ""], rng.randrange(1, 3)):
                rows.append((f"d{i % 7}{i}", doc[0], s, slot, doc[1], doc[2], doc[3], doc[4], doc[5], rng.choice(["all", "kp", None]), len(rows)))
    return spark.createDataFrame(rows, COLUMNS)


def _rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


CONFIGS = [
    K.CandidateConfig(),
    K.CandidateConfig(all_pairs_max_docs=4, support_top_k=2, conflict_top_k=1, rare_tokens=2, max_token_docs=4, candidate_pool_size=3, max_chunk_docs=9, chunk_overlap=3, near_duplicate_jaccard=0.7),
    K.CandidateConfig(all_pairs_max_docs=0, support_top_k=0, conflict_top_k=2, rare_tokens=3, max_token_docs=40, candidate_pool_size=50, max_chunk_docs=25, chunk_overlap=0, max_entity_docs=20, pair_sample_rate=0.6),
]


@pytest.mark.parametrize("config", CONFIGS)
@pytest.mark.parametrize("most", [50_000, 70])
def test_same_pairs_as_by_bucket(spark, monkeypatch, config, most):
    monkeypatch.setattr(K, "MOST_ANCHORS", most)  # with 70, the larger subjects are dealt by bucket
    an = _anchors(spark)
    want = _rows(K.merge(K.contributions(an, K.features(an), config)))
    assert len(want) > 20 and _rows(K.build_candidates(an, config)) == want


def test_single_subjects_and_small_pieces(spark, monkeypatch):
    an = _anchors(spark, 90, 1, 5)
    want = _rows(K.merge(K.contributions(an, K.features(an), CONFIGS[1])))
    assert want and _rows(K.build_candidates(an, CONFIGS[1])) == want


def test_pairs_of_buckets_and_their_scores(spark, monkeypatch):
    an = _anchors(spark, 40)
    sized = K.chunks(K.usable(K.members(K.routes(an)))).withColumn("n", K.F.col("docs")).where("n <= 20")
    small = K.small_pairs(sized)
    cols = [*K.BUCKET, "doc_a", "doc_b"]
    all_scores = K.CandidateConfig(near_duplicate_jaccard=2.0)
    for most in (50_000, 40):
        monkeypatch.setattr(K, "MOST_ANCHORS", most)
        assert _rows(K.bucket_pairs(an).select(cols)) == _rows(small.select(cols))
        assert _rows(K.small_scores(an, all_scores)) == _rows(K.scored(small, K.features(an), all_scores))


def test_whole_records(spark, monkeypatch):
    an = _anchors(spark)
    F = K.F
    struct = F.struct(F.col("subject").alias("norm"), F.col("doc_id").alias("text"))
    nested = an.select("doc_id", F.struct(F.col("kp_key").alias("key")).alias("knowledge_point"), "confidence", struct.alias("subject"), F.lit("e").alias("evidence"), "dates", "numbers", "source_domain", F.col("seq").alias("place"))
    want = _rows(K.records(K.merge(K.contributions(an, K.features(an), CONFIGS[1])), K.references(nested), K.subject_structs(nested)))
    reference = F.struct("doc_id", F.struct(F.col("kp_key").alias("key")).alias("knowledge_point"), "confidence", F.lit("e").alias("evidence"), "dates", "numbers", "source_domain")
    for most in (50_000, 70):
        monkeypatch.setattr(K, "MOST_ANCHORS", most)
        assert _rows(K.build_records(an.select("*", reference.alias("reference"), struct.alias("subject_struct")), CONFIGS[1])) == want


def test_pairs_are_not_shuffled(spark):
    """Documents of one subject each: nothing is exchanged after the anchors are dealt by subject."""
    an = _anchors(spark, 30, 1)
    plan = K.build_candidates(an)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_pieces_are_whole_subjects(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pairing, "ANCHORS_AT_A_TIME", 4)
    batches = [pa.RecordBatch.from_pydict({"subject": list(x)}) for x in ("aab", "bbbb", "b", "ccc", "d", "e")]
    got = ["".join(t.column("subject").to_pylist()) for t in pairing._pieces(iter(batches))]
    assert "".join(got) == "aabbbbbbcccde" and all(not (set(x) & set(y)) for x, y in zip(got, got[1:]))
    x = pairing.round6(pairing.np.array([0.1234565, 2.0000005, -0.1234565, 1 / 3, 7.5]))
    assert x.tolist() == [0.123457, 2.000001, -0.123457, 0.333333, 7.5]
