"""The stages as commands over files: ``python -m contrasto.cli COMMAND --help``.

Results lie under ``--results-dir``, each stage in a folder of its own name; a finished stage is read by the next.
A command prints its report as JSON and returns 1 when a dataset is invalid.
"""

from __future__ import annotations

import argparse
import json
import os
import time
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasto.functions import text as T
from contrasto.operators import agent, evaluation, export, mentions, prepare, recall, relations, responders, stages, verification, web
from contrasto.operators import candidates as K
from contrasto.sources import jsonl, lookups, store

TAGS = "document_id string, status string, is_knowledge_bearing boolean, content_type string, language string, tags array<struct<confidence:double,discipline:string,field:string,subfield:string,evidence:string>>"
ENTITIES = "document_id string, entities array<struct<text:string,norm:string,label:string,count:int,first_start:int,surface_forms:array<string>>>"
RELATION = "pair_id string, doc_a_id string, doc_b_id string, status string, relation string, judgment struct<confidence:double>"
ITEM = "benchmark_id string, item_group_id string, eval struct<question:string,gold_answers:array<struct<value:string>>,preferred_answer:string>"
RESULT = "benchmark_id string, status string, judgment struct<label:string>, effective_grade struct<credit:string>, judge_grade struct<credit:string>, grade struct<credit:string>"
KNOWN = "doc_a string, doc_b string, src_doc_id string, dst_doc_id string, left_doc_id string, right_doc_id string, provenance struct<conflict_edge:struct<src_doc_id:string,dst_doc_id:string>>"
ANSWERS = "key string, attempt int, response string"
TRACES = f"subgraph_id string, trace {agent._kind('trace')}"
RESPONSE = "benchmark_id string, status string, answer string"
SYNTHESIS = "subgraph_id string, status string, qa struct<keep:boolean,questions:array<struct<formulation:string,question:string>>,gold_answers:array<struct<value:string>>,preferred_answer:string>"
DECISION = "subgraph_id string, status string, {0} struct<keep:boolean,verdict:string>"


#: Stages that decide whether a question is kept, and the column of the decision.
DECISIONS = {"synthesis": "qa", "source_validation": "validation", "verification": "verification"}
#: Commands that return 1 if any of their rows is an error.
FAIL_ON_ERRORS = ("tag-kp", "synthesize", "validate-sources", "verify")


class Run:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args, self.root = spark, args, args.results_dir.rstrip("/")

    def read(self, values: list[str], schema: str) -> DataFrame:
        return jsonl.read_jsonl(self.spark, jsonl.expand_inputs(values), schema)

    def save(self, df: DataFrame, stage: str) -> DataFrame:
        path = f"{self.root}/{stage}"
        df.write.mode("overwrite" if self.args.overwrite else "errorifexists").parquet(path)
        return self.load(stage)

    def load(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{stage}")

    def config(self, kind):
        given = {f.name: getattr(self.args, f.name, None) for f in fields(kind)}
        base = kind.command_line() if hasattr(kind, "command_line") else kind()
        return replace(base, **{k: v for k, v in given.items() if v is not None})

    # each stage returns its report

    def build_store(self) -> dict:
        return store.ingest(self.spark, jsonl.expand_inputs(self.args.input), f"{self.root}/store")

    def prepare(self) -> dict:
        conf = self.config(prepare.PreparationConfig)
        keys = ["shard_id", "document_id"]
        tags = self.read(self.args.tags, TAGS).withColumn("shard_id", jsonl.shard_id()) if self.args.tags else self.latest("tags", "document_id")
        ner = self.read(self.args.entities, ENTITIES).withColumn("shard_id", jsonl.shard_id()) if self.args.entities else self.latest("entities", "document_id")
        lookups.match_shards(tags.select("shard_id", "file").distinct(), ner.select("shard_id", "file").distinct())
        domains = self.spark.read.parquet(f"{self.root}/store/docs").select(F.col("canonical_doc_id").alias("document_id"), T.source_domain("url").alias("source_domain"))
        rows = prepare.signals(tags, prepare.latest_entities(ner, keys, "line"), conf, keys)
        made = self.save(prepare.anchors(rows, domains, conf), "anchors")
        return prepare.manifest(rows, made).first().asDict()

    def _flat(self) -> DataFrame:
        made = self.load("anchors")
        both = ["dates", "numbers", "tokens", "source_domain"]
        return made.withColumn("seq", F.col("place").cast("long")).select("doc_id", F.col("knowledge_point.key").alias("kp_key"), F.col("subject.norm").alias("subject"), "slot", "confidence", F.coalesce("subject.alias_scope", F.lit("all")).alias("alias_scope"), "seq", *both)

    def candidates(self) -> dict:
        conf = self.config(K.CandidateConfig)
        an = self._flat()
        pairs = self.save(K.build_candidates(an, conf), "candidates")
        made = self.load("anchors")
        whole = K.records(pairs, K.references(made), K.subject_structs(made))
        jsonl.write_jsonl(whole.orderBy("doc_a.doc_id", "doc_b.doc_id"), f"{self.root}/candidates.jsonl")
        report = {r["route"]: r.asDict() for r in K.bucket_stats(K.members(K.routes(an)), conf).collect()}  # two routes
        if self.args.known_pairs:
            report["recall"] = recall.pair_recall(pairs, self._known()).first().asDict()
        return report | {"candidate_pairs": pairs.count()}

    def _known(self) -> DataFrame:
        return lookups.known_pairs(self.read([self.args.known_pairs], KNOWN).drop("file", "line"))

    def audit_blocking(self) -> dict:
        return self._audit(recall.audit_blocking)

    def audit_preparation(self) -> dict:
        return self._audit(recall.audit_preparation)

    def _audit(self, audit) -> dict:
        return {r["reason"]: r["count"] for r in audit(self._flat(), self._known()).groupBy(F.coalesce("reason", F.lit("recovered")).alias("reason")).count().collect()}

    def subgraphs(self) -> dict:
        if self.args.relations:
            rows = self.read(self.args.relations, RELATION).withColumn("confidence", F.col("judgment.confidence")).withColumn("seq", F.struct("file", "line"))
        else:
            rows = self.load("relations").select("pair_id", "doc_a_id", "doc_b_id", "status", "relation", F.col("judgment.confidence").alias("confidence"), F.col("run").alias("seq"))
        r = relations.usable_relations(rows)
        docs = self.spark.read.parquet(f"{self.root}/store/docs").select(F.col("canonical_doc_id").alias("doc_id"), "url", "text")
        graphs = relations.subgraphs(r, None, self.args.support_per_endpoint, self.args.min_support_per_endpoint, self.args.max_subgraphs)
        made = self.save(relations.attach_documents(graphs, docs), "subgraphs")
        return relations.coverage(r, r, self.args.min_support_per_endpoint).first().asDict() | {"selected_subgraphs": made.count()}

    def export(self) -> dict:
        parts = [self.rows(getattr(self.args, name), name, kind) for name, kind in (("synthesis", SYNTHESIS), ("source_validation", DECISION.format("validation")), ("verification", DECISION.format("verification")))]
        out = self.save(export.export_records(*parts), "benchmark")
        jsonl.write_jsonl(out.select("benchmark_id", "item_group_id", "eval").orderBy("item_group_id", "benchmark_id"), f"{self.root}/benchmark.jsonl")
        counts = export.decisions(*parts).groupBy(F.coalesce("reason", F.lit("groups_exported")).alias("reason")).count()
        return {r["reason"]: r["count"] for r in counts.collect()} | {"questions_exported": out.count()}

    # stages that ask a model

    def rows(self, path: str | None, stage: str, kind: str) -> DataFrame:
        """Rows of a stage with their order as seq: from a file where one is given, else from the stage's folder."""
        if path:
            return self.read([path], kind).withColumn("seq", F.struct("file", "line"))
        return self.load(stage).withColumnRenamed("run", "seq")

    def latest(self, stage: str, key: str) -> DataFrame:
        return lookups.latest(self.load(stage), key, "run").withColumn("line", F.col("run"))

    def responder(self) -> responders.Responder:
        a, system = self.args, ""
        if self.args.prompt:
            with jsonl.opened_input(self.args.prompt) as f:
                system = f.read().decode().strip()
        if a.answers:
            return responders.replay(self.read([a.answers], ANSWERS).select("key", "attempt", "response"))
        if not a.base_url:
            raise ValueError("--base-url or --answers is needed")
        return responders.http_responder(f"{a.base_url.rstrip('/')}/chat/completions", a.model, system, self.headers(), a.request_retries, a.timeout, temperature=0.0, max_tokens=a.max_tokens)

    def headers(self) -> dict[str, str]:
        return responders.parse_headers(self.args.header) | ({"Authorization": f"Bearer {self.args.api_key}"} if self.args.api_key else {})

    def part(self, tasks: DataFrame, key: str) -> DataFrame:
        """The shard of the tasks that this call is to do, up to its limit."""
        if self.args.shards > 1:
            tasks = lookups.take_shard(tasks, key, self.args.shard, self.args.shards)
        return tasks.orderBy(key).limit(self.args.limit) if self.args.limit > 0 else tasks

    def finish(self, tasks: DataFrame, stage: str, key: str, ask) -> dict:
        """Ask for what is still to be done and add it to the stage's rows; with --no-resume they begin anew."""
        path, tasks = f"{self.root}/{stage}", self.part(tasks, key)
        done = self._have(path) if self.args.resume else None
        pending = tasks if done is None else tasks.join(done.where("status = 'success'").select(key).distinct(), key, "left_anti")
        out = ask(pending).withColumn("run", F.lit(time.time_ns()))
        out.write.mode("append" if done is not None else "overwrite").parquet(path)
        mine = self.spark.read.parquet(path)
        new = mine.where(F.col("run") == mine.agg(F.max("run")).first()[0]) if mine.limit(1).count() else mine
        counts = {r["status"]: r["count"] for r in new.groupBy("status").count().collect()}  # two rows
        counts_of: dict[str, int] = {}
        part = DECISIONS.get(stage)
        if part:
            for r in new.where("status = 'success'").groupBy(F.col(f"{part}.keep").alias("keep"), (F.col(f"{part}.verdict") if part != "qa" else F.lit(None).cast("string")).alias("verdict")).count().collect():  # a few rows
                for name in ("kept" if r["keep"] else "rejected", f"verdict_{r['verdict']}" if r["verdict"] else None):
                    if name:
                        counts_of[name] = counts_of.get(name, 0) + r["count"]
        return counts_of | {"stage": stage, "submitted": sum(counts.values()), "resumed": done.where("status = 'success'").select(key).distinct().count() if done is not None else 0, **counts}

    def _have(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _documents(self) -> DataFrame:
        rows = jsonl.raw_documents(self.read(self.args.input, jsonl.RAW_DOCUMENT)).withColumn("shard_id", jsonl.shard_id())
        a = self.args
        if a.max_docs > 0 and a.max_docs_per_shard > 0:
            raise ValueError("use only one of --max-docs and --max-docs-per-shard")
        if a.max_docs > 0 or a.max_docs_per_shard > 0:
            files = sorted(r[0] for r in rows.select("file").distinct().collect())  # one row a file
            quota = lookups.quotas(a.max_docs, len(files)) if a.max_docs > 0 else [a.max_docs_per_shard] * len(files)
            rows = lookups.take_per_shard(rows, dict(zip(files, quota)), "file")
        return rows.withColumnRenamed("canonical_doc_id", "document_id")

    def tag_kp(self) -> dict:
        paths = [r["path"] for r in lookups.load_taxonomy(self.spark.read.option("multiLine", True).json(self.args.taxonomy)).orderBy("path").collect()]  # part of every prompt
        docs = self._documents()
        where = docs.select("document_id", "shard_id", "file").dropDuplicates(["document_id"])
        ask = lambda d: stages.tag(d, paths, self.responder(), retries=self.args.validation_retries, most_chars=self.args.max_sentence_chars).join(where, "document_id")
        return self.finish(docs.select("document_id", "url", "text").dropDuplicates(["document_id"]), "tags", "document_id", ask)

    def tag_ner(self) -> dict:
        a = self.args
        labeller = mentions.onnx_labeller(a.model, a.tokenizer, a.labels.split(","))
        docs = self._documents()
        where = docs.select("document_id", "shard_id", "file").dropDuplicates(["document_id"])
        ask = lambda d: mentions.tag_entities(d, labeller, a.allowed.split(",") if a.allowed else None, a.max_length, a.overlap_chars, a.tokenizer, a.batch_size).join(where, "document_id").withColumn("status", F.lit("success"))
        return self.finish(docs.select("document_id", "text").dropDuplicates(["document_id"]), "entities", "document_id", ask)

    def _store(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/store/docs").select(F.col("canonical_doc_id").alias("doc_id"), "url", "text")

    def classify(self) -> dict:
        made = relations.compact(self.load("candidates"), K.features(self._flat()))
        return self.finish(made, "relations", "pair_id", lambda t: stages.classify(relations.tasks(t, self._store()), self.responder(), self.args.validation_retries))

    def synthesize(self) -> dict:
        return self.finish(self.load("subgraphs"), "synthesis", "subgraph_id", lambda t: stages.synthesize(t, self.responder(), self.args.validation_retries))

    def validate_sources(self) -> dict:
        rows = self.rows(self.args.synthesis, "synthesis", SYNTHESIS)
        kept = lookups.latest_kept(rows, "qa").withColumn("seq", F.lit(0))
        return self.finish(kept, "source_validation", "subgraph_id", lambda t: stages.validate_sources(t, self.load("subgraphs"), self.responder(), self.args.validation_retries))

    def verify(self) -> dict:
        q, v = self.rows(self.args.synthesis, "synthesis", SYNTHESIS), self.rows(self.args.source_validation, "source_validation", DECISION.format("validation"))
        conf = self.config(verification.VerificationConfig)

        def ask(tasks: DataFrame) -> DataFrame:
            a = self.args
            if a.traces:
                traces = self.read([a.traces], TRACES)
            else:
                if not a.base_url or not a.search_url:
                    raise ValueError("--base-url and --search-url, or --traces, are needed")
                chat = agent.http_chat(f"{a.base_url.rstrip('/')}/chat/completions", a.model, "", self.headers(), a.timeout, temperature=0.0, max_tokens=a.max_tokens)
                traces = agent.web_traces(tasks, chat, web.search_text(a.search_url, a.search_key), web.fetch_page, conf)
            return stages.verify(tasks, traces, conf)

        report = self.finish(stages.verification_tasks(q, v, self.load("subgraphs")), "verification", "subgraph_id", ask)
        return report | stages.verification_report(q, v).first().asDict()

    def run(self) -> dict:
        items = lookups.require_unique(self.read([self.args.benchmark], ITEM), "benchmark_id")
        if bad := items.where(F.size(evaluation.item_errors()) > 0).limit(1).count():
            raise ValueError(f"{bad} invalid item or more in the benchmark")
        report = self.finish(items, "responses", "benchmark_id", lambda t: stages.answer(t, self.responder()))
        jsonl.write_jsonl(lookups.latest(self.load("responses"), "benchmark_id", "run").select("benchmark_id", "status", "answer", "error"), f"{self.root}/responses.jsonl")
        return report

    def judge(self) -> dict:
        items = lookups.require_unique(self.read([self.args.benchmark], ITEM), "benchmark_id")
        given = self.read([self.args.responses], RESPONSE) if self.args.responses else lookups.latest(self.load("responses"), "benchmark_id", "run")
        report = self.finish(given.select("benchmark_id", "status", "answer"), "judgments", "benchmark_id", lambda t: stages.judge(t, items, self.responder()))
        jsonl.write_jsonl(lookups.latest(self.load("judgments"), "benchmark_id", "run").select("benchmark_id", "status", "answer", "judgment"), f"{self.root}/judgments.jsonl")
        return report

    def all(self) -> dict:
        return {"prepare": self.prepare(), "candidates": self.candidates()}

    def inspect(self) -> dict:
        with jsonl.opened_input(f"{self.root}/{self.args.stage}.report.json") as f:
            return json.loads(f.read())

    def _labels(self, path: str) -> DataFrame:
        r = self.read([path], RESULT)
        label = evaluation.label_of("judgment.label", F.col("judgment").isNotNull(), "effective_grade.credit", "judge_grade.credit", "grade.credit")
        return r.select("benchmark_id", "status", label.alias("label"))

    def score(self) -> dict:
        items = lookups.require_unique(self.read([self.args.benchmark], ITEM), "benchmark_id")
        results = self._labels(self.args.results)
        evaluation.guard_results(items, results)
        return evaluation.summarize(items, results).first().asDict()

    def analyze(self) -> dict:
        items = lookups.require_unique(self.read([self.args.benchmark], ITEM), "benchmark_id")
        named = dict(x.split("=", 1) for x in self.args.result)
        if len(named) != len(self.args.result):
            raise ValueError("labels of results must be unique")
        rows = None
        for name, path in named.items():
            one = self._labels(path).withColumn("model", F.lit(name))
            rows = one if rows is None else rows.unionByName(one)
        evaluation.guard_results(items, rows, "model")
        models = {r["model"]: r.asDict() for r in evaluation.summarize(items, rows, rows).collect()}  # one row a model
        curve = evaluation.oracle_curve(items, rows.where("status = 'success'").unionByName(rows.where("status <> 'success'").withColumn("label", F.lit("failed"))))
        return {"models": models, "greedy_oracle": [r.asDict() for r in curve.orderBy("models").collect()]}

    def validate(self) -> dict:
        items = self.read([self.args.dataset], ITEM)
        errors = evaluation.dataset_errors(items).orderBy("line", "error").limit(self.args.max_errors)
        return evaluation.dataset_report(items).first().asDict() | {"examples": [r.asDict() for r in errors.collect()]}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contrasto", description=__doc__)
    p.add_argument("--results-dir", default="outputs/construction")
    p.add_argument("--overwrite", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, configs=(), given=()):
        c = sub.add_parser(name)
        for r in required:
            c.add_argument(f"--{r}", required=True, nargs="+" if r == "input" else None)
        for f in [f for k in configs for f in fields(k)]:
            kind = {"int": int, "float": float, "str": str}.get(f.type)
            c.add_argument(f"--{f.name.replace('_', '-')}", default=None, **({"type": kind} if kind else {"action": argparse.BooleanOptionalAction}))
        for g in given:  # from a file instead of from the stage before
            c.add_argument(f"--{g}", nargs="+" if g in ("tags", "entities", "relations") else None)
        return c

    def part(c):
        c.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
        for name, kind, value in (("limit", int, 0), ("shard", int, 0), ("shards", int, 1)):
            c.add_argument(f"--{name}", type=kind, default=value)
        return c

    def model(c, retries: int = 1):
        """What every stage that asks a model takes; ``--answers`` are recorded ones, ``--prompt`` a file with a system prompt."""
        for name, kind, value in (("base-url", str, ""), ("api-key", str, os.environ.get("OPENAI_API_KEY", "")), ("model", str, ""), ("answers", str, ""), ("prompt", str, ""), ("timeout", float, 1200.0), ("request-retries", int, 2), ("validation-retries", int, retries), ("max-tokens", int, 8192)):
            c.add_argument(f"--{name}", type=kind, default=value)
        c.add_argument("--header", action="append", default=[], metavar="NAME=VALUE")
        return part(c)

    def some(c):
        for name in ("max-docs", "max-docs-per-shard"):
            c.add_argument(f"--{name}", type=int, default=0)
        return c

    command("build-store", "input")
    some(model(command("tag-kp", "input", "taxonomy"), 2)).add_argument("--max-sentence-chars", type=int, default=1200)
    c = some(part(command("tag-ner", "input", "model", "tokenizer", "labels", given=["allowed"])))
    for name, value in (("max-length", 510), ("overlap-chars", 100), ("batch-size", 256)):
        c.add_argument(f"--{name}", type=int, default=value)
    command("prepare", configs=[prepare.PreparationConfig], given=["tags", "entities"])
    command("candidates", configs=[K.CandidateConfig], given=["known-pairs"])
    command("all", configs=[prepare.PreparationConfig, K.CandidateConfig], given=["tags", "entities", "known-pairs"])
    command("inspect").add_argument("--stage", default="candidates")
    model(command("classify"), 2)
    command("audit-blocking", "known-pairs")
    command("audit-preparation", "known-pairs")
    c = command("subgraphs", given=["relations"])
    for name, value in (("support-per-endpoint", 2), ("min-support-per-endpoint", 1), ("max-subgraphs", 0)):
        c.add_argument(f"--{name}", type=int, default=value)
    model(command("synthesize"))
    model(command("validate-sources", given=["synthesis"]))
    model(command("verify", configs=[verification.VerificationConfig], given=["synthesis", "source-validation", "traces", "search-url", "search-key"]))
    command("export", given=["synthesis", "source-validation", "verification"])
    model(command("run", "benchmark"))
    model(command("judge", "benchmark", given=["responses"]))
    command("score", "benchmark", "results")
    command("analyze", "benchmark").add_argument("--result", action="append", required=True, metavar="LABEL=PATH")
    c = command("validate")
    c.add_argument("dataset")
    c.add_argument("--max-errors", type=int, default=100)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    run = Run(spark or SparkSession.builder.appName("contrasto").getOrCreate(), args)
    report = getattr(run, args.command.replace("-", "_"))()
    print(json.dumps(report, ensure_ascii=False, indent=2, default=str))
    if args.command not in ("inspect", "validate"):
        jsonl.write_manifest(f"{run.root}/{args.command}.report.json", json.loads(json.dumps(report, default=str)))
    if args.command in FAIL_ON_ERRORS:
        return int(bool(report.get("error")))
    return int(args.command == "validate" and not report["valid"])


if __name__ == "__main__":
    raise SystemExit(main())
