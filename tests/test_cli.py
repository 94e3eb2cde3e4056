import json

from pyspark.sql import functions as F

from contrasto import cli
from contrasto.operators import verification


def _write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_construction(spark, tmp_path, capsys):
    root = str(tmp_path / "out")
    docs = _write(tmp_path / "docs.jsonl", [{"document_id": d, "url": f"https://www.{d}.test/", "text": f"text {d}"} for d in "abcd"])
    evidence = "Example Person won the election with {} votes against the other candidate on 2001-02-03"
    tag = lambda d, n, k: {"document_id": d, "status": "success", "language": "en", "tags": [{"confidence": 0.95, "discipline": "Society", "field": "Politics", "subfield": k, "evidence": evidence.format(n)}, {"confidence": 0.8, "subfield": "x", "evidence": ""}]}
    tags = _write(tmp_path / "shard_00000001.kp.jsonl", [tag("a", 12, "Elections"), tag("b", 13, "Elections"), tag("c", 14, "Other"), {"document_id": "d", "status": "error"}])
    (tmp_path / "ner").mkdir()
    ner = _write(tmp_path / "ner" / "shard_00000001.ner.jsonl", [{"document_id": d, "entities": [{"text": "Example Person", "norm": "example person", "label": "person", "count": 1, "first_start": 3}]} for d in "abc"])
    run = lambda *a: cli.main(["--results-dir", root, *a], spark)
    report = lambda: json.loads(capsys.readouterr().out)
    assert run("build-store", "--input", docs) == 0 and report()["documents"] == 4
    assert run("prepare", "--tags", tags, "--entities", ner) == 0
    made = report()
    assert made["documents_with_anchors"] == 3 and made["reasons"] == {"missing_tag": 1}
    anchor = spark.read.parquet(f"{root}/anchors").where("doc_id = 'a' and slot = 'votes'").first()
    assert anchor["subject"]["norm"] == "example person" and anchor["knowledge_point"]["subfield"] == "Elections" and anchor["source_domain"] == "a.test"
    known = _write(tmp_path / "known.jsonl", [{"doc_a": "b", "doc_b": "a"}, {"src_doc_id": "a", "dst_doc_id": "d"}])
    assert run("candidates", "--known-pairs", known) == 0
    made = report()
    assert made["candidate_pairs"] == 3 and made["recall"]["recovered_pairs"] == 1
    assert run("audit-blocking", "--known-pairs", known) == 0 and report() == {"recovered": 1, "endpoint_missing_anchor": 1}
    assert run("audit-preparation", "--known-pairs", known) == 0 and report() == {"recovered": 1, "endpoint_missing_anchor": 1}
    rel = _write(tmp_path / "rel.jsonl", [{"pair_id": p, "doc_a_id": a, "doc_b_id": b, "status": "success", "relation": r, "judgment": {"confidence": 0.9}} for p, a, b, r in (("p1", "a", "b", "conflict"), ("p2", "a", "c", "support"), ("p3", "b", "d", "support"))])
    assert run("subgraphs", "--relations", rel) == 0 and report()["selected_subgraphs"] == 1
    keep = {"keep": True, "verdict": "verified"}
    qa = {"keep": True, "questions": [{"formulation": "named_entity", "question": "n"}, {"formulation": "clue_based", "question": "c"}], "gold_answers": [{"value": "12"}, {"value": "13"}], "preferred_answer": "12"}
    files = [_write(tmp_path / f"{n}.jsonl", [{"subgraph_id": "subgraph-p1", "status": "success", n: v}]) for n, v in (("qa", qa), ("validation", keep), ("verification", keep))]
    assert run("export", "--synthesis", files[0], "--source-validation", files[1], "--verification", files[2]) == 0 and report()["questions_exported"] == 2
    items = [json.loads(x) for x in spark.read.text(f"{root}/benchmark.jsonl").toPandas()["value"]]
    bench = _write(tmp_path / "bench.jsonl", items)
    assert run("validate", bench) == 0 and report()["valid"]
    one = _write(tmp_path / "one.jsonl", [{"benchmark_id": items[0]["benchmark_id"], "status": "success", "judgment": {"label": "full_credit"}}])
    two = _write(tmp_path / "two.jsonl", [{"benchmark_id": items[1]["benchmark_id"], "status": "success", "grade": {"credit": "complete"}}])
    assert run("score", "--benchmark", bench, "--results", one) == 0 and report()["c_rate"] == 0.5
    assert run("analyze", "--benchmark", bench, "--result", f"x={one}", "--result", f"y={two}") == 0
    assert [c["c_rate"] for c in report()["greedy_oracle"]] == [0.5, 1.0]
    assert run("validate", _write(tmp_path / "bad.jsonl", items[:1])) == 1


def _final(quote, keep=True):
    check = lambda v, q: {"value": v, "verified": True, "sources": [{"source_id": "source-1", "quote": q}]}
    return json.dumps({"keep": keep, "verdict": "verified", "same_subject": True, "same_attribute": True, "same_fact_context": True, "qa_valid": True, "reason": "r", "answer_verifications": [check("12", "12 votes"), check("30", quote)]})


def test_verification_budgets(spark):
    fetch = {"requested_url": "https://w/", "url": "https://w/", "text": "It got 12 votes, not 30."}
    rows = [("ok", ["q1", "q2"], [_final("not 30")]), ("late", ["q1", "q2"], ["nonsense", _final("not 30")]), ("quote", ["q1", "q2"], [_final("thirty"), _final("thirty")]), ("lazy", ["q1"], [_final("not 30")] * 2), ("none", ["q1", "q2"], [])]
    schema = "subgraph_id string, trace struct<searches:array<string>,fetches:array<struct<requested_url:string,url:string,text:string>>,finals:array<string>>"
    df = spark.createDataFrame([(i, (s, [fetch], f)) for i, s, f in rows], schema)
    qa = F.struct(F.array(F.struct(F.lit("12").alias("value")), F.struct(F.lit("30").alias("value"))).alias("gold_answers"))
    df = df.withColumn("qa", qa).withColumn("documents", F.array(F.struct(F.lit("https://seed/").alias("url"))))
    got = {r["subgraph_id"]: r for r in verification.judge_traces(df).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"ok": "success", "late": "success", "quote": "success", "lazy": "error", "none": "error"}
    assert got["ok"]["attempts"] == 1 and got["late"]["attempts"] == 2 and got["ok"]["verification"]["verdict"] == "verified"
    assert got["quote"]["verification"]["verdict"] == "insufficient_evidence" and not got["quote"]["verification"]["keep"] and "WebSearch separately" in got["lazy"]["error"]
    few = verification.judge_traces(df, verification.VerificationConfig(search_budget=1)).first()
    assert few["status"] == "error" and few["attempts"] == 0


def test_model_stages(spark, tmp_path, capsys, monkeypatch):
    """Every stage that asks a model, from raw documents to judged answers, with recorded answers."""
    import hashlib
    import re

    from contrasto.operators import mentions

    root = str(tmp_path / "out")
    run = lambda *a: cli.main(["--results-dir", root, *a], spark)
    report = lambda: json.loads(capsys.readouterr().out)
    votes = {"a": 12, "b": 13, "c": 12, "d": 13}
    text = {d: f"Example Person won the election with {n} votes against the other candidate on 2001-02-0{k}. More about {d}." for k, (d, n) in enumerate(votes.items(), 1)}
    docs = _write(tmp_path / "shard_00000001.jsonl", [*({"document_id": d, "url": f"https://www.{d}.test/", "text": t} for d, t in text.items()), {"document_id": "empty", "url": "https://e.test/", "text": " "}])
    tree = tmp_path / "taxonomy.json"
    tree.write_text(json.dumps({"disciplines": [{"name": "Society", "fields": [{"name": "Politics", "subfields": [{"name": "Elections"}]}]}]}, indent=1))
    answers = lambda name, rows: _write(tmp_path / f"{name}.jsonl", [{"key": k, "attempt": n, "response": v if isinstance(v, str) else json.dumps(v)} for k, n, v in rows])
    tag = {"is_knowledge_bearing": True, "content_type": "news", "language": "en", "reason": "r", "tag_paths": [{"path": "Society -> Politics -> Elections", "confidence": 0.95, "evidence_start_sentence": 1, "evidence_end_sentence": 1}]}
    assert run("build-store", "--input", docs) == 0 and report()["documents"] == 5
    assert run("tag-kp", "--input", docs, "--taxonomy", str(tree), "--answers", answers("tags", [*((d, 1, tag) for d in "abc"), ("d", 1, "no"), ("d", 2, tag)])) == 1
    assert (made := report())["success"] == 4 and made["error"] == 1
    assert run("tag-kp", "--input", docs, "--taxonomy", str(tree), "--answers", answers("again", [])) == 1 and report()["resumed"] == 4
    assert run("inspect", "--stage", "tag-kp") == 0 and report()["submitted"] == 1

    def labeller(*files):
        word = re.compile(r"[A-Z]\w+")
        return lambda: lambda texts: [[(m.start(), m.end(), "B-PER" if m[0] == "Example" else "I-PER" if m[0] == "Person" else "B-ORG") for m in word.finditer(t)] for t in texts]

    monkeypatch.setattr(mentions, "onnx_labeller", labeller)
    assert run("tag-ner", "--input", docs, "--model", "m", "--tokenizer", "", "--labels", "O", "--allowed", "person") == 0 and report()["success"] == 5
    assert run("all") == 0
    made = report()
    assert made["prepare"]["documents_with_anchors"] == 4 and made["candidates"]["candidate_pairs"] == 6
    first = json.loads(sorted(r[0] for r in spark.read.text(f"{root}/candidates.jsonl").collect())[0])
    assert first["doc_a"]["doc_id"] < first["doc_b"]["doc_id"] and first["subjects"][0]["norm"] == "example person" and first["retrieval_scores"]["best_conflict"]["number_mismatch"] in (True, False)
    pair = lambda x, y: "pair-" + hashlib.sha1(f"{x}\0{y}".encode()).hexdigest()[:20]
    said = lambda same: {"relation": "none", "same_subject": True, "same_attribute": True, "same_fact_context": True, "values_compatible": same, "confidence": 0.9, **{k: "x" for k in ("subject", "attribute", "value_a", "value_b", "evidence_a", "evidence_b", "reason")}}
    judged = [(pair(x, y), 1, said(votes[x] == votes[y])) for x in "abcd" for y in "abcd" if x < y and (x, y) in (("a", "b"), ("a", "c"), ("b", "d"))]
    assert run("classify", "--answers", answers("relations", judged)) == 0 and report()["success"] == 3
    assert run("subgraphs") == 0 and report()["selected_subgraphs"] == 1
    graph = f"subgraph-{pair('a', 'b')}"
    span = lambda n: [{"doc_id": "a" if n == 12 else "b", "quote": f"{n} votes"}]
    qa = {"keep": True, "subject": "p", "attribute": "votes", "preferred_answer": "12", "questions": [{"formulation": f, "question": "How many?"} for f in ("named_entity", "clue_based")], "gold_answers": [{"value": str(n), "supporting_doc_ids": [span(n)[0]["doc_id"]], "evidence_spans": span(n)} for n in (12, 13)]}
    assert run("synthesize", "--answers", answers("qa", [(graph, 1, {}), (graph, 2, qa)])) == 0
    assert (made := report())["success"] == 1 and made["kept"] == 1
    flags = {k: True for k in ("keep", "same_subject", "same_attribute", "same_fact_context", "qa_valid")} | {"verdict": "verified", "reason": "r"}
    sources = flags | {"answer_verifications": [{"value": str(n), "supported": True, "evidence_spans": span(n), "reason": "r"} for n in (12, 13)]}
    assert run("validate-sources", "--answers", answers("sources", [(graph, 1, sources)])) == 0 and report()["success"] == 1
    web = flags | {"answer_verifications": [{"value": str(n), "verified": True, "sources": [{"source_id": "source-1", "url": "https://w/", "quote": f"{n} votes"}], "reason": "r"} for n in (12, 13)]}
    page = {"requested_url": "https://w/", "url": "https://w/", "text": "12 votes, some say 13 votes"}
    traces = _write(tmp_path / "traces.jsonl", [{"subgraph_id": graph, "trace": {"searches": ["q", "r"], "fetches": [page], "finals": [json.dumps(web)]}}])
    assert run("verify", "--traces", traces) == 0 and (made := report())["success"] == 1 and made["synthesized_kept"] == 1 and made["verdict_verified"] == 1
    assert run("export") == 0 and report()["questions_exported"] == 2
    items = [json.loads(x) for x in spark.read.text(f"{root}/benchmark.jsonl").toPandas()["value"]]
    bench = _write(tmp_path / "bench.jsonl", items)
    assert run("run", "--benchmark", bench, "--answers", answers("responses", [(items[0]["benchmark_id"], 1, "It was 12 or 13.")])) == 0
    assert (made := report())["success"] == 1 and made["error"] == 1
    full = {"credit": "full_credit", "reasoning": "r", "gold_assessments": [{"covered": True}, {"covered": True}], "material_contradictions": []}
    assert run("judge", "--benchmark", bench, "--answers", answers("judgments", [(items[0]["benchmark_id"], 1, full)])) == 0
    report()
    got = {r["benchmark_id"]: r["judgment"]["label"] for r in spark.read.parquet(f"{root}/judgments").collect()}
    assert got == {items[0]["benchmark_id"]: "complete", items[1]["benchmark_id"]: "failed"}


def test_web_agent(spark):
    """Conversations with tools: budgets, a page read once, and a second round after a wrong answer."""
    from contrasto.operators import agent

    call = lambda name, **given: {"id": "1", "function": {"name": name, "arguments": json.dumps(given)}}
    check = lambda v: {"value": v, "verified": True, "sources": [{"source_id": "source-1", "quote": f"{v} votes"}]}
    final = {k: True for k in ("keep", "same_subject", "same_attribute", "same_fact_context", "qa_valid")} | {"verdict": "verified", "reason": "r", "answer_verifications": [check("12"), check("13")]}

    def chat(messages):
        turn = sum(m["role"] == "assistant" for m in messages)
        if turn == 0:
            return {"content": None, "tool_calls": [call("WebSearch", query=f"q{k}") for k in range(5)]}
        if turn == 1:
            return {"content": None, "tool_calls": [call("WebFetch", url="https://w/"), call("WebFetch", url="https://w/"), call("Other"), {"id": "x", "function": {"name": "WebFetch", "arguments": "{"}}]}
        if "never" in messages[0]["content"]:
            raise OSError("no endpoint")
        if turn == 2 and "late" in messages[0]["content"]:
            return {"content": "let me think"}
        return {"content": json.dumps(final)}

    read = []
    fetch = lambda url: read.append(url) or ({"url": url, "text": "12 votes, some say 13 votes"} if url else {"error": "no address"})
    rows = [(i, i, (([("12",), ("13",)]),), [("https://seed/", )]) for i in ("good", "late", "never")]
    tasks = spark.createDataFrame(rows, "subgraph_id string, prompt string, qa struct<gold_answers:array<struct<value:string>>>, documents array<struct<url:string>>")
    traces = agent.web_traces(tasks, chat, lambda q: f"results of {q}", fetch)
    got = {r["subgraph_id"]: r["trace"] for r in traces.collect()}
    assert {k: (len(t["searches"]), len(t["fetches"]), len(t["finals"])) for k, t in got.items()} == {"good": (3, 1, 1), "late": (3, 1, 2), "never": (3, 1, 0)}
    done = {r["subgraph_id"]: (r["status"], r["attempts"]) for r in verification.judge_traces(tasks.join(traces, "subgraph_id")).collect()}
    assert done["good"] == ("success", 1) and done["late"] == ("success", 2) and done["never"][0] == "error"
