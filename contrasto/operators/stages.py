"""The stages that ask a model, as tables to tables over ``run_stage``: tags, relations, questions, their checks, answers, judgments.

Each takes a responder, so a live endpoint and recorded answers give rows of the same form: a key, status, the stage's value (null in
errors), error and attempts.  Rows that need no model (an empty text, a missing document) are decided first and never sent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasto.functions import text as T
from contrasto.operators import evaluation, mentions, relations, validators, verification
from contrasto.operators.responders import Responder, run_stage
from contrasto.sources.lookups import latest, latest_kept
from contrasto.sources.tables import materialize

QA = (
    "keep boolean, rejection_reason string, subject string, attribute string, preferred_answer string, questions array<struct<formulation:string,question:string>>, "
    "gold_answers array<struct<value:string,supporting_doc_ids:array<string>,evidence_spans:array<struct<doc_id:string,quote:string>>>>"
)
VALIDATION = (
    "keep boolean, verdict string, same_subject boolean, same_attribute boolean, same_fact_context boolean, qa_valid boolean, reason string, "
    "answer_verifications array<struct<value:string,supported:boolean,evidence_spans:array<struct<doc_id:string,quote:string>>,reason:string>>"
)

# What a model is told in each stage.
SYNTHESIS_TASK = (
    "You get documents that disagree about one fact, and documents that support either side. Write one question about the fact twice: once naming its subject (formulation named_entity), once describing it by clues that "
    "don't name it (clue_based). List every answer that the documents give as a gold answer, each with the ids of its documents and quotations copied word for word. No question may hold an answer. Say which answer is preferred. "
    "If the documents don't disagree about the same fact, answer keep=false with a rejection_reason and no questions or answers. Reply with one JSON object: keep, rejection_reason, subject, attribute, preferred_answer, questions "
    "(formulation, question), gold_answers (value, supporting_doc_ids, evidence_spans with doc_id and quote)."
)
SOURCE_TASK = (
    "You get a question, its proposed answers and the documents they came from. By these documents alone, decide for every answer whether they support it, with quotations copied word for word, and whether all answers are about the same "
    "subject, attribute and context of the fact, so that the question is fair. Keep the question only if everything holds. Reply with one JSON object: keep, verdict (verified or rejected), same_subject, same_attribute, same_fact_context, "
    "qa_valid, reason, answer_verifications (value, supported, evidence_spans with doc_id and quote, reason)."
)
WEB_TASK = (
    "You get a question, its proposed answers and the addresses they came from. Search the web once for each answer at least, open pages that are independent of those addresses, and decide for every answer whether they confirm it, with "
    "quotations copied word for word from pages that you opened. Reply with one JSON object: keep, verdict (verified, rejected or insufficient_evidence), same_subject, same_attribute, same_fact_context, qa_valid, reason, "
    "answer_verifications (value, verified, sources with source_id, url and quote, reason)."
)


def synthesis_prompt(graph: Column) -> Column:
    """What is asked of a subgraph (a struct with its documents)."""
    return F.concat(F.lit(f"{SYNTHESIS_TASK}\n\nSubgraph: "), F.to_json(graph))


def source_prompt(qa: Column, documents: Column) -> Column:
    return F.concat(F.lit(f"{SOURCE_TASK}\n\nQuestion and documents: "), F.to_json(F.struct(qa.alias("qa"), documents.alias("documents"))))


def web_prompt(qa: Column, documents: Column, validation: Column) -> Column:
    """What a web agent is asked: the question, the addresses that don't count as independent, and the decision on its sources."""
    seeds = F.transform(documents, lambda d: d["url"])
    return F.concat(F.lit(f"{WEB_TASK}\n\nQuestion: "), F.to_json(F.struct(qa.alias("qa"), seeds.alias("seed_urls"), validation.alias("source_validation"))))


def _finished(done: DataFrame, key: str, value: str, early: DataFrame | None = None) -> DataFrame:
    """Stage rows under the stage's own names; early: key and error of rows that were never sent."""
    kind = done.schema["value"].dataType
    good = F.when(F.col("status") == "success", F.col("value"))
    out = done.select(F.col("key").alias(key), "status", good.alias(value), F.when(F.col("status") == "error", F.array_join("errors", "; ")).alias("error"), F.col("rounds").cast("int").alias("attempts"))
    if early is not None:
        out = out.unionByName(early.select(F.col("key").alias(key), F.lit("error").alias("status"), F.lit(None).cast(kind).alias(value), "error", F.lit(0).alias("attempts")))
    return out


def parsed(kind: str) -> Callable[[Column], Column]:
    """The JSON object in an answer, as a struct; null where there is none."""
    return lambda c: F.when(evaluation.json_object(c) != "", F.from_json(evaluation.json_object(c), kind))


def tag(docs: DataFrame, paths: list[str], responder: Responder, content_types: list[str] | None = None, retries: int = 2, most_chars: int = 1200) -> DataFrame:
    """docs: document_id, url, text.  Rows: document_id, status, url, tags (with levels and evidence), language, content_type, is_knowledge_bearing, reason, error, attempts.

    paths: the taxonomy's, part of every prompt and so of a bounded number.
    """
    rows = docs.select(F.col("document_id").alias("key"), "url", mentions.sentences("text", most_chars).alias("numbered"))
    # written, as the prompts, the checks and the evidence read the sentences
    rows = materialize(rows, "sentences")
    legal = F.array(*map(F.lit, paths))
    tasks = rows.where(F.size("numbered") > 0).withColumn("prompt", mentions.tag_prompt("url", "numbered", "; ".join(paths)))
    done = run_stage(tasks, responder, parsed(mentions.CONTENT), lambda df: mentions.tag_errors("value", "numbered", legal, content_types), retries)
    out = _finished(done, "document_id", "value", rows.where(F.size("numbered") == 0).select("key", F.lit("document text is empty").alias("error")))
    out = out.join(rows.withColumnRenamed("key", "document_id"), "document_id")
    made = mentions.normalized_tags("value", "numbered")
    return out.select("document_id", "status", "url", F.coalesce(made, F.array()).alias("tags"), *[F.col(f"value.{c}").alias(c) for c in ("language", "content_type", "is_knowledge_bearing", "reason")], "error", "attempts")


def classify(tasks: DataFrame, responder: Responder, retries: int = 2) -> DataFrame:
    """tasks: pair_id, doc_a, doc_b, metadata, and of each document url and text.  Rows: pair_id, doc_a_id, doc_b_id, status, relation, model_relation, judgment, error, attempts.

    The relation follows from the judgment's flags; what the model called it is kept where it differs.
    """
    texts = [T.normalize_space(f"text_{s}") for s in "ab"]
    error = F.when(F.col("text_a").isNull() | F.col("text_b").isNull(), "document missing from the store").when((texts[0] == "") | (texts[1] == ""), "document text is empty")
    rows = tasks.select(F.col("pair_id").alias("key"), "doc_a", "doc_b", "metadata", "url_a", "url_b", texts[0].alias("text_a"), texts[1].alias("text_b"), error.alias("early"))
    rows = materialize(rows, "pairs")
    asked = rows.where("early is null").withColumn("prompt", relations.user_prompt("metadata")).select("key", "prompt")
    done = run_stage(asked, responder, parsed(relations.JUDGMENT), lambda df: F.array_compact(F.array(relations.relation_error("value"))), retries)
    out = _finished(done, "pair_id", "judgment", rows.where("early is not null").select("key", F.col("early").alias("error")))
    out = out.join(rows.select(F.col("key").alias("pair_id"), F.col("doc_a").alias("doc_a_id"), F.col("doc_b").alias("doc_b_id")), "pair_id")
    relation = F.when(F.col("judgment").isNotNull(), relations.derived_relation("judgment"))
    said = F.when(relation != F.col("judgment.relation"), F.col("judgment.relation"))
    return out.select("pair_id", "doc_a_id", "doc_b_id", "status", relation.alias("relation"), said.alias("model_relation"), "judgment", "error", "attempts")


def synthesize(graphs: DataFrame, responder: Responder, retries: int = 1) -> DataFrame:
    """graphs: subgraph_id, documents and whatever else a model should see.  Rows: subgraph_id, status, qa, error, attempts."""
    tasks = graphs.select(F.col("subgraph_id").alias("key"), synthesis_prompt(F.struct(*graphs.columns)).alias("prompt"), "documents")
    return _finished(run_stage(tasks, responder, parsed(QA), lambda df: validators.qa_errors("value", "documents"), retries), "subgraph_id", "qa")


def _with_graphs(rows: DataFrame, graphs: DataFrame) -> DataFrame:
    """Rows with the documents of their subgraph; raises where one has none."""
    out = rows.join(graphs.select("subgraph_id", "documents", F.lit(True).alias("has_graph")), "subgraph_id", "left")
    out = materialize(out, "graphs")
    if out.where("has_graph is null").limit(1).count():
        raise ValueError("a question has no matching subgraph")
    return out.drop("has_graph")


def validate_sources(synthesis: DataFrame, graphs: DataFrame, responder: Responder, retries: int = 1) -> DataFrame:
    """The latest kept questions against all documents of their subgraphs.  Rows: subgraph_id, status, validation, error, attempts."""
    rows = _with_graphs(latest_kept(synthesis, "qa").select("subgraph_id", "qa"), graphs)
    rows = rows.withColumn("wrong", validators.qa_errors("qa", "documents"))
    tasks = rows.where(F.size("wrong") == 0).select(F.col("subgraph_id").alias("key"), source_prompt(F.col("qa"), F.col("documents")).alias("prompt"), "qa", "documents")
    done = run_stage(tasks, responder, parsed(VALIDATION), lambda df: validators.source_errors("value", "qa", "documents"), retries)
    early = rows.where(F.size("wrong") > 0).select(F.col("subgraph_id").alias("key"), F.concat(F.lit("synthesis/subgraph mismatch: "), F.array_join("wrong", "; ")).alias("error"))
    return _finished(done, "subgraph_id", "validation", early)


def verification_tasks(synthesis: DataFrame, sources: DataFrame, graphs: DataFrame) -> DataFrame:
    """Questions to verify on the web: the latest kept synthesis, the latest verified source validation and the subgraph, by subgraph_id.

    Rows: subgraph_id, qa, validation, documents, prompt.  Raises where a kept question has no subgraph.
    """
    kept = _with_graphs(latest_kept(synthesis, "qa").select("subgraph_id", "qa"), graphs)
    good = latest_kept(sources, "validation").where("validation.verdict = 'verified'").select("subgraph_id", "validation")
    rows = kept.join(good, "subgraph_id")
    return rows.select("subgraph_id", "qa", "validation", "documents", web_prompt(F.col("qa"), F.col("documents"), F.col("validation")).alias("prompt"))


def verification_report(synthesis: DataFrame, sources: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One row: how many questions go on to web verification and why others don't."""
    q, v = latest(synthesis), latest(sources)
    kept = latest_kept(synthesis, "qa").select("subgraph_id")
    good = latest_kept(sources, "validation").where("validation.verdict = 'verified'").select("subgraph_id")
    both = kept.join(good.withColumn("good", F.lit(True)), "subgraph_id", "left")
    one = both.agg(F.count("good").alias("synthesized_kept"), (F.count("*") - F.count("good")).alias("synthesis_rows_without_verified_sources"))
    skipped = q.agg(F.count("*").alias("q")).crossJoin(kept.agg(F.count("*").alias("k"))).select((F.col("q") - F.col("k")).alias("synthesis_rows_skipped"))
    lost = v.agg(F.count("*").alias("v")).crossJoin(good.agg(F.count("*").alias("g"))).select((F.col("v") - F.col("g")).alias("source_validation_rows_skipped"))
    return one.crossJoin(skipped).crossJoin(lost)  # single rows


def verify(tasks: DataFrame, traces: DataFrame, config: verification.VerificationConfig = verification.VerificationConfig()) -> DataFrame:
    """Tasks judged by what an agent did.  traces: subgraph_id, trace; a task without a trace has done nothing."""
    return verification.judge_traces(tasks.join(traces.select("subgraph_id", "trace"), "subgraph_id", "left"), config)


def answer(items: DataFrame, responder: Responder) -> DataFrame:
    """Closed-book answers.  items: benchmark_id, eval.  Rows: benchmark_id, status, answer, error, attempts."""
    tasks = items.select(F.col("benchmark_id").alias("key"), F.col("eval.question").alias("prompt"))
    blank = lambda df: F.array_compact(F.array(F.when(F.trim("value") == "", "empty answer")))
    return _finished(run_stage(tasks, responder, lambda c: c, blank, retries=0), "benchmark_id", "answer")


def judge(responses: DataFrame, items: DataFrame, responder: Responder) -> DataFrame:
    """responses: benchmark_id, status, answer.  Rows: benchmark_id, status, answer, judgment (label, rationale, error); a failed response or judge makes the label failed."""
    evaluation.guard_results(items, responses)
    rows = responses.select("benchmark_id", "status", "answer").join(items.select("benchmark_id", "eval"), "benchmark_id")
    tasks = rows.where("status = 'success'").select(F.col("benchmark_id").alias("key"), evaluation.judge_prompt("answer").alias("prompt"), F.size("eval.gold_answers").alias("golds"))
    got = materialize(responder(tasks.select("key", "prompt", F.lit(1).alias("attempt"))), "judged").select(F.col("key").alias("benchmark_id"), "response", F.col("error").alias("failure"))
    out = rows.join(got, "benchmark_id", "left").withColumn("j", evaluation.parse_judgment("response", F.size("eval.gold_answers")))
    ok = F.col("status") == "success"
    error = F.when(ok, F.coalesce("failure", F.when(F.col("response").isNull(), "no answer of the judge"), "j.error"))
    label = F.when(ok & error.isNull(), F.col("j.label")).otherwise("failed")
    why = F.when(~ok, "The model gave no answer that can be scored.").when(error.isNotNull(), F.concat(F.lit("Judge error: "), error)).otherwise(F.col("j.rationale"))
    return out.select("benchmark_id", "status", "answer", F.struct(label.alias("label"), why.alias("rationale"), error.alias("error")).alias("judgment"))
