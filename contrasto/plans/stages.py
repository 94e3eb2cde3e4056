"""Registered queries of the stages that ask a model, answered from tables, with their SQL.

Answers are made from the tables' numbers, so that some are right at once, some after a correction and some never.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions import text as T
from contrasto.operators import mentions, relations, responders, stages, verification
from contrasto.plans import catalog
from contrasto.plans.registry import query, table
from contrasto.sources import adapters as A

_PATHS = ["Science -> Prose -> Long", "Science -> Prose -> Short"]


def _two_rounds(keys: DataFrame, first, second) -> DataFrame:
    """Recorded answers of two attempts.  keys: key, k and what the answers read."""
    both = keys.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    return both.select("key", "attempt", F.when(F.col("attempt") == 1, first).otherwise(second).alias("response"))


@query(f"""WITH s AS ({catalog._SENTENCES}) SELECT CAST(doc_id AS STRING) AS document_id, CASE WHEN len(s) = 0 OR doc_id % 7 = 0 THEN 'error' ELSE 'success' END AS status,
    CASE WHEN len(s) = 0 OR doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'Long' ELSE 'Short' END AS subfield, CASE WHEN len(s) = 0 OR doc_id % 7 = 0 THEN '' ELSE md5(s[1].sentence) END AS evidence,
    CASE WHEN len(s) = 0 THEN 'document text is empty' WHEN doc_id % 7 = 0 THEN 'tag_paths[0] has an invalid taxonomy path' ELSE '' END AS error,
    CASE WHEN len(s) = 0 THEN 0 WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM s""")
def x6_tag_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("https://a.example/").alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("document_id").cast("long")
    path = F.when(k % 2 == 0, _PATHS[0]).otherwise(_PATHS[1])
    value = lambda p: F.concat(F.lit("Well: "), F.to_json(F.struct(F.lit(True).alias("is_knowledge_bearing"), F.lit("prose").alias("content_type"), F.lit("en").alias("language"), F.lit("r").alias("reason"), F.array(F.struct(p.alias("path"), F.lit(0.9).alias("confidence"), F.lit(1).alias("evidence_start_sentence"), F.lit(1).alias("evidence_end_sentence"))).alias("tag_paths"))))
    keys = d.select(F.col("document_id").alias("key"), "document_id")
    answers = _two_rounds(keys, value(F.when((k % 7 == 0) | (k % 3 == 0), "Other").otherwise(path)), value(F.when(k % 7 == 0, "Other").otherwise(path)))
    out = stages.tag(d, _PATHS, responders.replay(answers), ["prose"], retries=1)
    first = F.try_element_at("tags", F.lit(1))
    return out.select("document_id", "status", F.coalesce(first["subfield"], F.lit("")).alias("subfield"), F.coalesce(F.md5(first["evidence"]), F.lit("")).alias("evidence"), F.coalesce("error", F.lit("")).alias("error"), "attempts")


@query(f"""WITH {catalog._REL}, p AS (SELECT pair_id, doc_a_id, CASE WHEN seq % 50 = 0 THEN 'x' || doc_b_id ELSE doc_b_id END AS doc_b_id, CAST(floor(seq / 2) AS BIGINT) AS k, seq % 50 = 0 AS missing FROM r)
    SELECT pair_id, doc_a_id, doc_b_id, CASE WHEN missing OR k % 17 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN missing OR k % 17 = 0 THEN '' WHEN k % 3 = 0 THEN 'none' WHEN k % 5 = 0 THEN 'support' ELSE 'conflict' END AS relation,
    CASE WHEN missing OR k % 17 = 0 OR (k % 3 <> 0 AND k % 5 <> 0) THEN '' ELSE 'conflict' END AS model_relation, CASE WHEN missing THEN 'document missing from the store' WHEN k % 17 = 0 THEN 'confidence must be in [0, 1]' ELSE '' END AS error,
    CASE WHEN missing THEN 0 WHEN k % 17 = 0 OR k % 4 = 0 THEN 2 ELSE 1 END AS attempts FROM p""")
def x6_classify_pairs(spark, sf_dir):
    """A model that calls everything a conflict; the flags of its judgments decide."""
    r = relations.usable_relations(A.select(spark, sf_dir, A.RELATIONS))
    k = F.floor(F.col("seq") / 2)
    r = r.select("pair_id", F.col("doc_a_id").alias("doc_a"), F.when(F.col("seq") % 50 == 0, F.concat(F.lit("x"), "doc_b_id")).otherwise(F.col("doc_b_id")).alias("doc_b"), F.lit("{}").alias("metadata"), k.alias("k"))
    docs = A.select(spark, sf_dir, A.ORDER_EVIDENCE).select(F.col("document_id").alias("doc_id"), "url", F.col("evidence").alias("text"))
    k = F.col("k")
    flags = [(k % 3 != 0).alias("same_subject"), F.lit(True).alias("same_attribute"), F.lit(True).alias("same_fact_context"), (k % 5 == 0).alias("values_compatible")]
    said = lambda trust: F.to_json(F.struct(F.lit("conflict").alias("relation"), *flags, *[F.lit("x").alias(n) for n in ("subject", "attribute", "value_a", "value_b", "evidence_a", "evidence_b", "reason")], trust.alias("confidence")))
    answers = _two_rounds(r.select(F.col("pair_id").alias("key"), "k"), F.when((k % 4 == 0) & (k % 17 != 0), "no object").otherwise(said(F.when(k % 17 == 0, 7.0).otherwise(0.5))), said(F.when(k % 17 == 0, 7.0).otherwise(0.5)))
    out = stages.classify(relations.tasks(r, docs), responders.replay(answers), retries=1)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("pair_id", "doc_a_id", "doc_b_id", "status", blank("relation"), blank("model_relation"), blank("error"), "attempts")


def _graphs(spark, sf_dir) -> DataFrame:
    """Orders as subgraphs of one document."""
    k = F.col("o_orderkey")
    docs = F.array(F.struct(F.lit("d1").alias("doc_id"), F.lit("https://seed.example/").alias("url"), F.concat(F.lit("It got 12 votes, not 30, in order "), k.cast("string")).alias("text")))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k.cast("string")).alias("subgraph_id"), docs.alias("documents"), k.alias("k"))


def _qa(quote) -> F.Column:
    gold = lambda v, q: F.struct(F.lit(v).alias("value"), F.array(F.lit("d1")).alias("supporting_doc_ids"), F.array(F.struct(F.lit("d1").alias("doc_id"), q.alias("quote"))).alias("evidence_spans"))
    asked = F.array(*[F.struct(F.lit(f).alias("formulation"), F.lit("how many").alias("question")) for f in C.FORMULATIONS])
    return F.struct(F.lit(True).alias("keep"), F.lit(None).cast("string").alias("rejection_reason"), F.lit("s").alias("subject"), F.lit("a").alias("attribute"), F.lit("12").alias("preferred_answer"), asked.alias("questions"), F.array(gold("12", quote), gold("30", F.lit("not 30"))).alias("gold_answers"))


def _dropped() -> F.Column:
    return F.struct(F.lit(False).alias("keep"), F.lit("no fact").alias("rejection_reason"))


@query("""SELECT concat('s', CAST(o_orderkey AS STRING)) AS subgraph_id, CASE WHEN o_orderkey % 4 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 10 <> 1 END AS keep,
    CASE WHEN o_orderkey % 4 = 0 THEN 'gold answer 0 evidence is not verbatim' ELSE '' END AS error, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM orders""")
def x6_synthesize_questions(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    k = F.col("k")
    good = F.when(k % 10 == 1, F.to_json(_dropped())).otherwise(F.to_json(_qa(F.lit("12 VOTES"))))
    bad = F.to_json(_qa(F.lit("13 votes")))
    answers = _two_rounds(g.select(F.col("subgraph_id").alias("key"), "k"), F.when(k % 4 == 0, bad).when(k % 3 == 0, "{}").otherwise(good), F.when(k % 4 == 0, bad).otherwise(good))
    out = stages.synthesize(g.drop("k"), responders.replay(answers))
    return out.select("subgraph_id", "status", F.col("qa.keep").alias("keep"), F.coalesce("error", F.lit("")).alias("error"), "attempts")


def _synthesis(spark, sf_dir) -> DataFrame:
    """Synthesis rows with retries: every fourth failed first, every eleventh is dropped, every thirteenth quotes what its document lacks."""
    g = _graphs(spark, sf_dir).select("subgraph_id", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt")).where("attempt = 0 or k % 4 = 0")
    k = F.col("k")
    # one struct type on both sides of the choice
    qa = F.from_json(F.when(k % 11 == 0, F.to_json(_dropped())).otherwise(F.to_json(_qa(F.when(k % 13 == 0, "13 votes").otherwise("12 votes")))), stages.QA)
    failed = (k % 4 == 0) & (F.col("attempt") == 0)
    return g.select("subgraph_id", F.when(failed, "error").otherwise("success").alias("status"), (k * 2 + F.col("attempt")).alias("seq"), F.when(~failed, qa).alias("qa"))


def _checked(flag: str, source: str) -> F.Column:
    spans = F.array(F.struct(F.lit("d1").alias("doc_id"), F.lit("got 12").alias("quote"))) if source == "evidence_spans" else F.array(F.struct(F.lit("source-1").alias("source_id"), F.lit("https://w.example/").alias("url"), F.lit("got 12").alias("quote")))
    other = F.transform(spans, lambda x: x.withField("quote", F.lit("not 30")))
    return F.array(*[F.struct(F.lit(v).alias("value"), F.lit(True).alias(flag), s.alias(source), F.lit("r").alias("reason")) for v, s in (("12", spans), ("30", other))])


def _decided(checks: F.Column, keep: F.Column, verdict: F.Column) -> F.Column:
    return F.struct(keep.alias("keep"), verdict.alias("verdict"), *[F.lit(True).alias(n) for n in ("same_subject", "same_attribute", "same_fact_context", "qa_valid")], F.lit("r").alias("reason"), checks.alias("answer_verifications"))


@query("""SELECT concat('s', CAST(o_orderkey AS STRING)) AS subgraph_id, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 9 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'rejected' ELSE 'verified' END AS verdict,
    CASE WHEN o_orderkey % 13 = 0 THEN 'synthesis/subgraph mismatch: gold answer 0 evidence is not verbatim' WHEN o_orderkey % 9 = 0 THEN 'not a JSON object' ELSE '' END AS error, CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 9 = 0 OR o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS attempts
    FROM orders WHERE o_orderkey % 11 <> 0""")
def x6_validate_sources(spark, sf_dir):
    g = _graphs(spark, sf_dir)
    k = F.col("k")
    good = F.to_json(_decided(_checked("supported", "evidence_spans"), k % 5 != 0, F.when(k % 5 == 0, "rejected").otherwise("verified")))
    wrong = F.to_json(_decided(_checked("supported", "evidence_spans"), F.lit(True), F.lit("rejected")))
    answers = _two_rounds(g.select(F.col("subgraph_id").alias("key"), "k"), F.when(k % 9 == 0, "none").when(k % 6 == 0, wrong).otherwise(good), F.when(k % 9 == 0, "none").otherwise(good))
    out = stages.validate_sources(_synthesis(spark, sf_dir), g, responders.replay(answers))
    return out.select("subgraph_id", "status", F.coalesce("validation.verdict", F.lit("")).alias("verdict"), F.coalesce("error", F.lit("")).alias("error"), "attempts")


def _validation(spark, sf_dir) -> DataFrame:
    """Source validations: every seventh failed, every fifth was rejected; every sixth was verified only at the second try."""
    k = F.col("k")
    g = _graphs(spark, sf_dir).select("subgraph_id", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt")).where("attempt = 0 or k % 6 = 0")
    failed = (k % 7 == 0) | ((k % 6 == 0) & (F.col("attempt") == 0))
    v = _decided(_checked("supported", "evidence_spans"), k % 5 != 0, F.when(k % 5 == 0, "rejected").otherwise("verified"))
    return g.select("subgraph_id", F.when(failed, "error").otherwise("success").alias("status"), (k * 2 + F.col("attempt")).alias("seq"), F.when(~failed, v).alias("validation"))


_TO_VERIFY = "FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0"


@query(f"""SELECT concat('s', CAST(o_orderkey AS STRING)) AS subgraph_id, CAST(2 AS INT) AS golds, CASE WHEN o_orderkey % 13 = 0 THEN '13 votes' ELSE '12 votes' END AS quote, md5('It got 12 votes, not 30, in order ' || CAST(o_orderkey AS STRING)) AS digest, 'verified' AS verdict {_TO_VERIFY}""")
def j11_verification_tasks(spark, sf_dir):
    """Latest kept questions joined with their subgraphs and verified source rows."""
    out = stages.verification_tasks(_synthesis(spark, sf_dir), _validation(spark, sf_dir), _graphs(spark, sf_dir))
    return out.select("subgraph_id", F.size("qa.gold_answers").alias("golds"), F.col("qa.gold_answers")[0]["evidence_spans"][0]["quote"].alias("quote"), F.md5(F.col("documents")[0]["text"]).alias("digest"), "validation.verdict")


@query("""SELECT count(*) FILTER (WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS synthesized_kept, count(*) FILTER (WHERE o_orderkey % 11 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0)) AS synthesis_rows_without_verified_sources,
    count(*) FILTER (WHERE o_orderkey % 11 = 0) AS synthesis_rows_skipped, count(*) FILTER (WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS source_validation_rows_skipped FROM orders""")
def j11_verification_report(spark, sf_dir):
    return stages.verification_report(_synthesis(spark, sf_dir), _validation(spark, sf_dir))


@query(f"""SELECT concat('s', CAST(o_orderkey AS STRING)) AS subgraph_id, CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'insufficient_evidence' ELSE 'verified' END AS verdict,
    CASE WHEN o_orderkey % 3 = 0 THEN 'verification must use WebSearch separately for every proposed answer' ELSE '' END AS error, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS searches {_TO_VERIFY}""")
def x7_web_verification(spark, sf_dir):
    """Traces of agents: every third searched once only, every fourth never quotes the page, every second at the second try."""
    tasks = stages.verification_tasks(_synthesis(spark, sf_dir), _validation(spark, sf_dir), _graphs(spark, sf_dir))
    k = F.col("k")
    good = F.to_json(_decided(_checked("verified", "sources"), F.lit(True), F.lit("verified")))
    thirteen = F.transform(_checked("verified", "sources"), lambda c: c.withField("sources", F.transform(c["sources"], lambda s: s.withField("quote", F.lit("thirteen")))))
    bad = F.to_json(_decided(thirteen, F.lit(True), F.lit("verified")))
    searches = F.when(k % 3 == 0, F.array(F.lit("q"))).otherwise(F.array(F.lit("q"), F.lit("r")))
    page = F.array(F.struct(F.lit("https://w.example/").alias("requested_url"), F.lit("https://w.example/").alias("url"), F.lit("It got 12 votes, not 30.").alias("text")))
    finals = F.array(F.when(k % 3 == 0, good).when(k % 4 == 0, bad).when(k % 2 == 0, "none").otherwise(good), F.when((k % 4 == 0) & (k % 3 != 0), bad).otherwise(good))
    traces = _graphs(spark, sf_dir).select("subgraph_id", F.struct(searches.alias("searches"), page.alias("fetches"), finals.alias("finals")).alias("trace"))
    out = stages.verify(tasks, traces, verification.VerificationConfig())
    return out.select("subgraph_id", "status", F.coalesce("verification.verdict", F.lit("")).alias("verdict"), F.coalesce("error", F.lit("")).alias("error"), "attempts", "searches")


def _bench(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    ev = F.struct(F.concat(F.lit("Who is "), k.cast("string")).alias("question"), F.array(F.struct(F.lit("a").alias("value")), F.struct(F.lit("b").alias("value"))).alias("gold_answers"))
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("benchmark_id"), ev.alias("eval"), k.alias("k"))


@query("""SELECT CAST(o_orderkey AS STRING) AS benchmark_id, CASE WHEN o_orderkey % 6 < 2 THEN 'error' ELSE 'success' END AS status, CASE WHEN o_orderkey % 6 < 2 THEN '' ELSE 'It is ' || o_orderkey END AS answer,
    CASE o_orderkey % 6 WHEN 0 THEN 'no recorded answer' WHEN 1 THEN 'empty answer' ELSE '' END AS error FROM orders""")
def x6_run_benchmark(spark, sf_dir):
    """Closed-book answers; some are missing, some blank."""
    items = _bench(spark, sf_dir)
    answers = items.where("k % 6 <> 0").select(F.col("benchmark_id").alias("key"), F.lit(1).alias("attempt"), F.when(F.col("k") % 6 == 1, " ").otherwise(F.concat(F.lit("It is "), "benchmark_id")).alias("response"))
    out = stages.answer(items, responders.replay(answers))
    return out.select("benchmark_id", "status", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("error", F.lit("")).alias("error"))


@query("""SELECT CAST(o_orderkey AS STRING) AS benchmark_id, CASE WHEN o_orderkey % 8 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN o_orderkey % 8 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'complete' ELSE 'partial' END AS label,
    CASE WHEN o_orderkey % 8 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'no recorded answer' WHEN o_orderkey % 7 = 0 THEN 'unknown judge label or credit' ELSE '' END AS error FROM orders""")
def x6_judge_answers(spark, sf_dir):
    items = _bench(spark, sf_dir)
    k = F.col("k")
    responses = items.select("benchmark_id", F.when(k % 8 == 0, "error").otherwise("success").alias("status"), F.lit("a").alias("answer"))
    credit = F.when(k % 7 == 0, "odd").when(k % 3 == 0, "full_credit").otherwise("partial_credit")
    covered = lambda c: F.struct(c.alias("covered"), F.lit("").alias("evidence"))
    value = F.to_json(F.struct(credit.alias("credit"), F.lit("r").alias("reasoning"), F.array(covered(F.lit(True)), covered(k % 3 == 0)).alias("gold_assessments"), F.array().cast("array<struct<claim:string,reason:string>>").alias("material_contradictions")))
    answers = items.where("k % 5 <> 0").select(F.col("benchmark_id").alias("key"), F.lit(1).alias("attempt"), value.alias("response"))
    out = stages.judge(responses, items, responders.replay(answers))
    return out.select("benchmark_id", "status", "judgment.label", F.coalesce("judgment.error", F.lit("")).alias("error"))
