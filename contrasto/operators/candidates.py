"""Candidate pairs: blocking by two routes, bounded pairing within buckets, scores once per document pair, merge.

Route ``kp`` puts anchors of one knowledge point, subject and slot together; route ``ner`` those of one subject
across knowledge points.  Buckets up to ``all_pairs_max_docs`` give all pairs; larger ones are cut into overlapping chunks in
hash order, and each document takes its best partners among those that share a rare token, or lie next to it on the hash ring.
Anchors are flat rows: doc_id, kp_key, subject, slot, confidence, alias_scope, seq (their order).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrasto.functions import text as T
from contrasto.operators import pairing
from contrasto.sources.tables import materialize


@dataclass(frozen=True)
class CandidateConfig:
    all_pairs_max_docs: int = 20
    support_top_k: int = 10
    conflict_top_k: int = 10
    rare_tokens: int = 8
    max_token_docs: int = 200
    candidate_pool_size: int = 200
    max_chunk_docs: int = 5000
    chunk_overlap: int = 64
    max_entity_docs: int = 200_000
    near_duplicate_jaccard: float = 0.95
    pair_sample_rate: float = 1.0

    @staticmethod
    def library(**changes) -> CandidateConfig:
        return CandidateConfig(**changes)

    @staticmethod
    def command_line(**changes) -> CandidateConfig:
        return CandidateConfig(**({"support_top_k": 0, "conflict_top_k": 1} | changes))


def flat_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors of the preparation as flat rows; seq is the place of an anchor among those of its document (by subject, then slot)."""
    seq = F.col("place").cast("long")
    return anchors.select("doc_id", F.col("knowledge_point.key").alias("kp_key"), F.col("subject.norm").alias("subject"), "slot", "confidence", F.coalesce("subject.alias_scope", F.lit("all")).alias("alias_scope"), seq.alias("seq"))


def features(anchors: DataFrame) -> DataFrame:
    """One row per document of what scores read; every anchor of a document has the same."""
    cols = ["kp_key", "confidence", "dates", "numbers", "tokens", "source_domain"]
    return anchors.groupBy("doc_id").agg(F.min_by(F.struct(*cols), "seq").alias("f"))


def routes(anchors: DataFrame) -> DataFrame:
    """Each anchor with its route and bucket columns; empty keys and scoped aliases are left out."""
    kp = anchors.where("kp_key <> '' and subject <> '' and slot <> ''").select("*", F.lit("kp").alias("route"), F.col("kp_key").alias("b1"), F.col("slot").alias("b2"))
    ner = anchors.where("subject <> '' and coalesce(alias_scope, 'all') <> 'kp'").select("*", F.lit("ner").alias("route"), F.lit("").alias("b1"), F.lit("").alias("b2"))
    return kp.unionByName(ner)


BUCKET = ["route", "b1", "subject", "b2"]


def members(routed: DataFrame) -> DataFrame:
    """One row per bucket and document: the anchor with the highest confidence, the earliest of equals."""
    order = F.struct((-F.col("confidence")).alias("c"), F.col("seq"))
    best = routed.groupBy(*BUCKET, "doc_id").agg(F.min_by(F.struct("kp_key", "slot", "confidence", "seq"), order).alias("a"))
    return best.select(*BUCKET, "doc_id", F.col("a.kp_key").alias("kp_key"), F.col("a.slot").alias("slot"), F.col("a.confidence").alias("confidence"), F.col("a.seq").alias("seq"))


def bucket_sizes(m: DataFrame) -> DataFrame:
    return m.groupBy(*BUCKET).agg(F.count("*").alias("docs"))


def bucket_stats(m: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Per route: buckets, members, the largest, singletons, all unbounded pairs, and those eligible."""
    by_kp = m.groupBy(*BUCKET, "kp_key").agg(F.count("*").alias("n"))
    size = by_kp.groupBy(*BUCKET).agg(F.sum("n").alias("docs"), F.sum(F.expr("n * (n - 1) div 2")).alias("same_kp"))
    pairs = F.expr("docs * (docs - 1) div 2")
    return size.groupBy("route").agg(
        F.count("*").alias("buckets"), F.sum("docs").alias("members"), F.max("docs").alias("max_bucket_docs"), F.count_if(F.col("docs") == 1).alias("singletons"),
        F.sum(pairs).alias("unbounded_pairs"), F.sum("same_kp").alias("same_kp_pairs"),
        F.sum(F.when(F.col("route") == "kp", pairs).otherwise(pairs - F.col("same_kp"))).alias("eligible_pairs"),
        F.count_if((F.col("route") == "ner") & (F.col("docs") > config.max_entity_docs)).alias("over_frequent"),
        F.count_if(F.col("docs") > config.max_chunk_docs).alias("split_buckets"),
    )


def usable(m: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Members of buckets with partners, without over-frequent entities; with the bucket's size and its number ``bid``.

    Later steps group by the number, so that buckets' names don't travel with every pair.
    """
    # written, so that numbers are given once, and the join has exchanges on both sides and Spark can split a frequent bucket
    sizes = materialize(bucket_sizes(m).where("docs > 1").withColumn("bid", F.monotonically_increasing_id()), "buckets")
    return m.join(sizes, BUCKET).where((F.col("route") != "ner") | (F.col("docs") <= config.max_entity_docs))


def chunks(m: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Members with their chunks: windows of ``max_chunk_docs`` in hash order, each overlapping the one before."""
    step = max(1, config.max_chunk_docs - config.chunk_overlap)
    small = m.where(F.col("docs") <= config.max_chunk_docs).withColumn("chunk", F.lit(0).cast("long"))
    # only buckets beyond one chunk are ranked; by bins of the hash, so that no task sorts a whole bucket
    large = m.where(F.col("docs") > config.max_chunk_docs).withColumn("hash", T.stable_hash("doc_id")).withColumn("bin", F.substring("hash", 1, 2))
    before = W.partitionBy("bid").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most 256 rows a bucket
    bins = large.groupBy("bid", "bin").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    place = F.row_number().over(W.partitionBy("bid", "bin").orderBy("hash", "doc_id"))
    i = F.col("i")
    first = F.greatest(F.lit(0), F.floor((i - config.max_chunk_docs) / step) + 1)
    large = large.withColumn("place", place).join(bins, ["bid", "bin"]).withColumn("i", F.col("base") + F.col("place") - 1)
    large = large.withColumn("chunk", F.explode(F.sequence(first, F.floor(i / step)))).select(*small.columns)
    return small.unionByName(large)


CHUNK = ["bid", "chunk"]


def eligible(a: str = "l", b: str = "r") -> Column:
    return (F.col(f"{a}.doc_id") != F.col(f"{b}.doc_id")) & ((F.col(f"{a}.route") == "kp") | (F.col(f"{a}.kp_key") != F.col(f"{b}.kp_key")))


def small_pairs(sized: DataFrame) -> DataFrame:
    """All eligible pairs of chunks up to the bound, with what ``sized`` has of the bucket's columns; sized: chunk members with n, the chunk's size."""
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in CHUNK] + [F.col("l.doc_id") < F.col("r.doc_id")]
    pairs = sized.alias("l").join(sized.alias("r"), on)
    return pairs.where(eligible()).select(*[F.col(f"l.{c}") for c in [*CHUNK, *BUCKET] if c in sized.columns], F.col("l.doc_id").alias("doc_a"), F.col("r.doc_id").alias("doc_b"))


def large_candidates(sized: DataFrame, feats: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """For each document of a large chunk its candidates (doc_id, other): rare-token pool, filled up from the ring."""
    tokens = sized.join(feats.select("doc_id", F.col("f.tokens").alias("tokens")), "doc_id").select(*CHUNK, "doc_id", "tokens")
    posted = tokens.select(*CHUNK, "doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
    often = posted.groupBy(*CHUNK, "token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy(*CHUNK, "doc_id").orderBy("df", "token"))
    rare = posted.join(often, [*CHUNK, "token"]).withColumn("r", rank).where(f"r <= {config.rare_tokens} and df <= {config.max_token_docs}")
    mine = rare.select(*CHUNK, "token", "doc_id")
    theirs = rare.select(*CHUNK, "token", F.col("doc_id").alias("other"))
    pool = mine.join(theirs, [*CHUNK, "token"]).where("doc_id <> other").select(*CHUNK, "doc_id", "other").distinct()
    # of a pool that is too large the candidates with most tokens in common
    seen = pool.join(tokens.withColumnRenamed("tokens", "lt"), [*CHUNK, "doc_id"]).join(tokens.select(*CHUNK, F.col("doc_id").alias("other"), F.col("tokens").alias("rt")), [*CHUNK, "other"])
    seen = seen.select(*CHUNK, "doc_id", "other", F.size(F.array_intersect("lt", "rt")).alias("common"))
    best = F.row_number().over(W.partitionBy(*CHUNK, "doc_id").orderBy(F.desc("common"), T.stable_hash("other"), "other"))
    pool = materialize(seen.withColumn("k", best).where(F.col("k") <= config.candidate_pool_size).select(*CHUNK, "doc_id", "other"), "pool")
    # neighbours on the ring of hashes, before and after in turn
    place = F.row_number().over(W.partitionBy(*CHUNK).orderBy(T.stable_hash("doc_id"), "doc_id")) - 1
    ring = sized.select(*CHUNK, "doc_id", "n").withColumn("place", place)
    have = pool.groupBy(*CHUNK, "doc_id").agg(F.count("*").alias("have"))
    want = F.least(F.lit(config.candidate_pool_size) - F.coalesce("have", F.lit(0)), F.col("n") - 1)
    asks = ring.join(have, [*CHUNK, "doc_id"], "left").withColumn("want", want).where("want > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("want").cast("int"))))
    asks = asks.withColumn("at", F.expr("pmod(place + CASE WHEN k % 2 = 1 THEN -((k + 1) div 2) ELSE k div 2 END, n)"))
    near = asks.join(ring.select(*CHUNK, F.col("place").alias("at"), F.col("doc_id").alias("other")), [*CHUNK, "at"]).where("doc_id <> other").select(*CHUNK, "doc_id", "other")
    both = pool.unionByName(near).distinct()
    kp = sized.select(*CHUNK, "doc_id", "kp_key", "route")
    both = both.join(kp, [*CHUNK, "doc_id"]).join(kp.select(*CHUNK, F.col("doc_id").alias("other"), F.col("kp_key").alias("other_kp")), [*CHUNK, "other"])
    return both.where("route = 'kp' or kp_key <> other_kp").select(*CHUNK, "doc_id", "other")


def scored(pairs: DataFrame, feats: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Distinct pairs doc_a < doc_b with their scores, near-duplicates left out."""
    one = pairs.select("doc_a", "doc_b").distinct()
    both = one.join(feats.select(F.col("doc_id").alias("doc_a"), F.col("f").alias("fa")), "doc_a").join(feats.select(F.col("doc_id").alias("doc_b"), F.col("f").alias("fb")), "doc_b")
    s = both.withColumn("scores", T.pair_scores(F.col("fa"), F.col("fb"))).withColumn("overlap", T.jaccard("fa.tokens", "fb.tokens"))
    copy = (F.col("overlap") >= config.near_duplicate_jaccard) & T.same_set(F.col("fa.dates"), F.col("fb.dates")) & T.same_set(F.col("fa.numbers"), F.col("fb.numbers"))
    return s.where(~copy).select("doc_a", "doc_b", "scores")


def top_pairs(candidates: DataFrame, scores: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Each document's best partners by support and by conflict score, as pairs."""
    c = candidates.select("*", F.least("doc_id", "other").alias("doc_a"), F.greatest("doc_id", "other").alias("doc_b")).join(scores, ["doc_a", "doc_b"])
    by = lambda k: F.row_number().over(W.partitionBy(*CHUNK, "doc_id").orderBy(F.desc(F.col("scores")[k]), "other"))
    cols = [*CHUNK, "doc_a", "doc_b"]
    parts = [c.withColumn("k", by(k)).where(F.col("k") <= most).select(*cols) for k, most in (("support_score", config.support_top_k), ("conflict_score", config.conflict_top_k)) if most > 0]
    out = parts[0] if parts else c.select(*cols).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def contributions(anchors: DataFrame, feats: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Pairs by bucket with their scores: route, subject, slot, kp keys through ``b1``; sampled by key if so configured."""
    # what several steps read is written once; else each of them would compute it again
    m = materialize(members(routes(anchors)), "members")  # its buckets are counted before they are joined
    feats = materialize(feats, "features")
    m = materialize(usable(m, config), "usable")
    cut = chunks(m.select("bid", "docs", "route", "doc_id", "kp_key"), config)
    sized = materialize(cut.join(cut.groupBy(*CHUNK).agg(F.count("*").alias("n")), CHUNK), "chunks")
    small = small_pairs(sized.where(F.col("n") <= config.all_pairs_max_docs))
    large = sized.where(F.col("n") > config.all_pairs_max_docs)
    cand = materialize(large_candidates(large, feats, config), "candidates")
    wide = cand.select(F.least("doc_id", "other").alias("doc_a"), F.greatest("doc_id", "other").alias("doc_b"))
    scores = materialize(scored(small.select("doc_a", "doc_b").unionByName(wide), feats, config), "scores")
    chosen = small.select("bid", "doc_a", "doc_b").unionByName(top_pairs(cand, scores, config).select("bid", "doc_a", "doc_b")).distinct()
    if config.pair_sample_rate < 1.0:
        chosen = chosen.where(T.unit_interval(F.concat("doc_a", F.lit("\0"), "doc_b")) < config.pair_sample_rate)
    names = m.select("bid", F.col("doc_id").alias("doc_a"), "route", "b1", "subject", "slot")
    return chosen.join(scores, ["doc_a", "doc_b"]).join(names, ["bid", "doc_a"]).select("doc_a", "doc_b", "route", "b1", "subject", "slot", "scores")


SIGNALS = {"kp": "same_kp_subject_slot", "ner": "tner_cross_kp_entity"}


def merge(contribs: DataFrame) -> DataFrame:
    """One row per pair: all signals and subjects, the slots of the knowledge-point route, and the best scores (a score of exactly 0 never counts).

    ``retrieval_scores`` holds the whole score structs that are best by support and by conflict, null where none counts.
    """
    signal = F.when(F.col("route") == "kp", SIGNALS["kp"]).otherwise(SIGNALS["ner"])
    counted = lambda k: F.when(F.col("scores")[k] != 0, F.col("scores")[k])
    best = [F.max_by(F.when(counted(f"{k}_score").isNotNull(), F.col("scores")), counted(f"{k}_score")).alias(f"best_{k}") for k in ("support", "conflict")]
    made = contribs.groupBy(T.pair_id("doc_a", "doc_b").alias("pair_id"), "doc_a", "doc_b").agg(
        F.array_sort(F.collect_set(signal)).alias("retrieval_signals"), F.array_sort(F.collect_set("subject")).alias("subjects"), F.array_sort(F.collect_set(F.when(F.col("route") == "kp", F.col("slot")))).alias("slots"),
        *best, F.max("scores.token_jaccard").alias("token_jaccard"),
    )
    whole = F.struct("best_support", "best_conflict").alias("retrieval_scores")
    return made.select("pair_id", "doc_a", "doc_b", "retrieval_signals", "subjects", "slots", F.col("best_support.support_score").alias("best_support"), F.col("best_conflict.conflict_score").alias("best_conflict"), "token_jaccard", whole)


def references(anchors: DataFrame) -> DataFrame:
    """(doc_id, reference) of the preparation's anchors: what a candidate record says of a document.  Every anchor of a document has the same."""
    cols = ["doc_id", "knowledge_point", "confidence", "evidence", "dates", "numbers", "source_domain"]
    return anchors.groupBy("doc_id").agg(F.min_by(F.struct(*cols), "place").alias("reference"))


def subject_structs(anchors: DataFrame) -> DataFrame:
    """(doc_id, norm, subject) of the preparation's anchors, the last of equal names."""
    return anchors.groupBy("doc_id", F.col("subject.norm").alias("norm")).agg(F.max_by("subject", "place").alias("subject"))


def records(pairs: DataFrame, refs: DataFrame, subjects: DataFrame) -> DataFrame:
    """Merged pairs as whole records: both documents' references, the subjects as the left document has them, by name, and the best scores.

    References join the final pairs only, so evidence never travels with candidates.
    """
    named = pairs.select("pair_id", "doc_a", F.explode("subjects").alias("norm")).join(subjects.withColumnRenamed("doc_id", "doc_a"), ["doc_a", "norm"])
    named = named.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("norm", "subject"))), lambda x: x["subject"]).alias("subjects"))
    side = lambda s: refs.select(F.col("doc_id").alias(f"doc_{s}"), F.col("reference").alias(f"ref_{s}"))
    out = pairs.drop("subjects").join(named, "pair_id", "left").join(side("a"), "doc_a").join(side("b"), "doc_b")
    return out.select("pair_id", F.col("ref_a").alias("doc_a"), F.col("ref_b").alias("doc_b"), "retrieval_signals", "subjects", "slots", "retrieval_scores")


#: Anchors of one subject that a task may take; larger subjects are dealt by bucket and chunk.
MOST_ANCHORS = 50_000


def crowded(anchors: DataFrame) -> DataFrame | None:
    """Subjects with too many anchors for one task: at most one for each ``MOST_ANCHORS``."""
    most = materialize(anchors.groupBy("subject").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ANCHORS).select("subject"), "crowded")
    return None if most.isEmpty() else F.broadcast(most)


def by_subject(anchors: DataFrame, run, schema: str, *more: str) -> DataFrame:
    """``run`` over whole subjects.  Every anchor of a document has the same features, so those of a document travel with each."""
    canonical = lambda c: F.to_json(F.array_sort(F.array_distinct(c))).alias(c)  # noqa: E731  (equal for equal sets)
    sent = anchors.select(
        "subject", "doc_id", "kp_key", "slot", F.col("confidence").cast("double").alias("confidence"), (F.coalesce("alias_scope", F.lit("all")) != "kp").alias("open"), F.col("seq").cast("long").alias("seq"),
        F.col("several") if "several" in anchors.columns else F.lit(False).alias("several"), canonical("dates"), canonical("numbers"), "tokens", "source_domain", *more,
    )
    return sent.repartition("subject").sortWithinPartitions(F.xxhash64("subject"), "subject").mapInArrow(run, schema)


def subject_pairs(anchors: DataFrame, config: CandidateConfig = CandidateConfig(), large: bool = True) -> tuple[DataFrame, bool]:
    """Chosen pairs with their scores, one row per subject and pair; and whether a pair may have several rows.

    anchors: flat, with features; where they have ``reference`` and ``subject_struct``, pairs get ``ref_a``, ``ref_b`` and ``subject_struct``.
    Without ``large`` only buckets up to ``all_pairs_max_docs`` give pairs.
    """
    anchors = anchors.where("subject <> ''")
    whole = [c for c in ("reference", "subject_struct") if c in anchors.columns]
    crowd = crowded(anchors)
    # only a pair of documents that both have several subjects can be found under more than one
    # (dealt by document first: both steps then hash without another exchange, where least and greatest strings would be sorted)
    several = materialize(anchors.select("doc_id", "subject").repartition("doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    shared = not several.isEmpty()
    few = anchors if crowd is None else anchors.join(crowd, "subject", "left_anti")
    if shared:
        few = few.join(several.withColumn("several", F.lit(True)), "doc_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    kinds = {f.name: f.dataType.simpleString() for f in anchors.schema}
    schema = pairing.PAIRS + (f", ref_a {kinds['reference']}, ref_b {kinds['reference']}, subject_struct {kinds['subject_struct']}" if whole else "")
    rows = by_subject(few, partial(pairing.subject_pairs, config=config, large=large), schema, *whole)
    if crowd is not None:
        rows = rows.unionByName(_crowded_pairs(anchors.join(crowd, "subject", "left_semi"), config, large, bool(whole)))
    if config.pair_sample_rate < 1.0:
        rows = rows.where(T.unit_interval(F.concat("doc_a", F.lit("\0"), "doc_b")) < config.pair_sample_rate)
    return rows, shared


def _crowded_pairs(anchors: DataFrame, config: CandidateConfig, large: bool, whole: bool) -> DataFrame:
    """``subject_pairs`` of subjects that are too large for one task."""
    feats = features(anchors)
    if large:
        found = contributions(anchors, feats, config)
    else:
        pairs = materialize(small_pairs(chunks(usable(members(routes(anchors)), config), config).withColumn("n", F.col("docs")).where(F.col("n") <= config.all_pairs_max_docs)), "pairs")
        found = pairs.join(scored(pairs, feats, config), ["doc_a", "doc_b"]).withColumn("slot", F.col("b2"))
    kp = F.col("route") == "kp"
    rows = found.groupBy("subject", "doc_a", "doc_b").agg(
        F.max(kp).alias("kp"), F.max(~kp).alias("ner"), F.array_sort(F.collect_set(F.when(kp, F.col("slot")))).alias("slots"), F.lit(True).alias("several"), F.any_value("scores").alias("s"),
    ).select("subject", "doc_a", "doc_b", "kp", "ner", "slots", "several", "s.*")
    if whole:
        refs = anchors.groupBy("doc_id").agg(F.min_by("reference", "seq").alias("ref"))
        rows = rows.join(refs.select(F.col("doc_id").alias("doc_a"), F.col("ref").alias("ref_a")), "doc_a").join(refs.select(F.col("doc_id").alias("doc_b"), F.col("ref").alias("ref_b")), "doc_b")
        rows = rows.join(anchors.groupBy(F.col("doc_id").alias("doc_a"), "subject").agg(F.max_by("subject_struct", "seq").alias("subject_struct")), ["doc_a", "subject"])
    return rows


def _one_per_pair(rows: DataFrame, shared: bool) -> DataFrame:
    """Rows of ``subject_pairs`` with one row per pair: its subjects, by name, and what the rows say together."""
    whole = "subject_struct" in rows.columns
    scores = F.struct(*[F.col(c) for c in ("token_jaccard", "date_mismatch", "number_mismatch", "same_source_domain", "support_score", "conflict_score")])
    named = F.struct("subject", "subject_struct") if whole else F.struct("subject")
    refs = ["ref_a", "ref_b"] if whole else []
    rows = rows.select("doc_a", "doc_b", "several", "kp", "ner", "slots", scores.alias("s"), named.alias("named"), *refs)
    if not shared:
        return rows.withColumn("named", F.array("named"))
    rows = materialize(rows, "pairs")  # read twice
    once = rows.where("not several").withColumn("named", F.array("named"))
    more = rows.where("several").groupBy("doc_a", "doc_b").agg(
        F.lit(True).alias("several"), F.max("kp").alias("kp"), F.max("ner").alias("ner"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("slots")))).alias("slots"), F.any_value("s").alias("s"),
        F.array_sort(F.collect_list("named"), lambda x, y: F.when(x["subject"] < y["subject"], -1).when(x["subject"] > y["subject"], 1).otherwise(0)).alias("named"), *[F.any_value(c).alias(c) for c in refs],
    )
    return once.unionByName(more)


def _described(rows: DataFrame) -> DataFrame:
    """``_one_per_pair`` with the columns of ``merge``; a score of exactly 0 never counts."""
    signals = F.array_compact(F.array(F.when(F.col("kp"), SIGNALS["kp"]), F.when(F.col("ner"), SIGNALS["ner"])))
    best = lambda k: F.when(F.col(f"s.{k}_score") != 0, F.col("s"))
    return rows.select(
        T.pair_id("doc_a", "doc_b").alias("pair_id"), "*", signals.alias("retrieval_signals"), F.col("named.subject").alias("subjects"), best("support")["support_score"].alias("best_support"), best("conflict")["conflict_score"].alias("best_conflict"),
        F.col("s.token_jaccard").alias("token_jaccard"), F.struct(best("support").alias("best_support"), best("conflict").alias("best_conflict")).alias("retrieval_scores"),
    )


def build_candidates(anchors: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Candidate pairs of flat anchors with features: what ``merge`` makes of ``contributions``, made subject by subject."""
    rows = _described(_one_per_pair(*subject_pairs(anchors, config)))
    return rows.select("pair_id", "doc_a", "doc_b", "retrieval_signals", "subjects", "slots", "best_support", "best_conflict", "token_jaccard", "retrieval_scores")


def build_records(anchors: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Whole records, as ``records``, of flat anchors with features, ``reference`` and ``subject_struct``: they travel with the anchors, and not once more with every pair."""
    rows = _described(_one_per_pair(*subject_pairs(anchors, config)))
    return rows.select("pair_id", F.col("ref_a").alias("doc_a"), F.col("ref_b").alias("doc_b"), "retrieval_signals", F.col("named.subject_struct").alias("subjects"), "slots", "retrieval_scores")


def _only_small(config: CandidateConfig) -> CandidateConfig:
    """Buckets are taken whole."""
    return replace(config, max_chunk_docs=1 << 40)


def bucket_pairs(anchors: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """All eligible pairs of buckets up to ``all_pairs_max_docs``, bucket by bucket."""
    anchors = anchors.where("subject <> ''")
    crowd = crowded(anchors)
    few = anchors if crowd is None else anchors.join(crowd, "subject", "left_anti")
    rows = by_subject(few, partial(pairing.bucket_pairs, config=_only_small(config)), pairing.SMALL)
    if crowd is None:
        return rows
    sized = chunks(usable(members(routes(anchors.join(crowd, "subject", "left_semi"))), config), config).withColumn("n", F.col("docs")).where(F.col("n") <= config.all_pairs_max_docs)
    return rows.unionByName(small_pairs(sized).select(*rows.columns))


def small_scores(anchors: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Distinct pairs of buckets up to ``all_pairs_max_docs`` with their scores, near-duplicates left out."""
    rows = _one_per_pair(*subject_pairs(anchors, _only_small(config), large=False))
    return rows.select("doc_a", "doc_b", F.col("s").alias("scores"))
