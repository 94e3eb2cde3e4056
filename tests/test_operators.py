import json

import pytest
import zstandard
from pyspark.sql import functions as F

from contrasto.operators import candidates as K
from contrasto.operators import evaluation, export, relations, responders, validators
from contrasto.sources import jsonl, lookups, store
from contrasto.streaming.ingest import ingest_stream


def _write(path, rows, zstd=False):
    data = "".join(json.dumps(r) + "\n" for r in rows).encode()
    if zstd:
        half = len(data) // 2
        data = b"".join(zstandard.ZstdCompressor(level=3).compress(x) for x in (data[:half], data[half:]))
    path.write_bytes(data)
    return str(path)


def test_jsonl_and_store(spark, tmp_path):
    a = _write(tmp_path / "shard_00000001.jsonl.zstd", [{"url": "u1", "text": "t1"}, {"url": "u2", "text": "t2"}], True)
    b = _write(tmp_path / "shard_00000002.jsonl", [{"url": "u2", "text": "t2"}, {"url": "u3", "content": "t3"}])
    assert jsonl.expand_inputs([str(tmp_path)]) == [a, b]
    rows = jsonl.read_jsonl(spark, [a, b], jsonl.RAW_DOCUMENT)
    assert sorted((r["line"], r["url"]) for r in rows.collect()) == [(1, "u1"), (1, "u2"), (2, "u2"), (2, "u3")]
    root = str(tmp_path / "store")
    assert store.ingest(spark, [a], root)["documents"] == 2
    both = store.ingest(spark, [a, b], root)
    assert both["documents"] == 3 and both["rows_seen"] == 4 and both["skipped_shards"] == 1
    assert store.ingest(spark, [a, b], root)["skipped_shards"] == 2


def test_strict_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"url": "u"}\n\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, [str(p)], "url string").collect()
    with pytest.raises(FileNotFoundError):
        jsonl.expand_inputs([str(tmp_path / "none*")])
    whole = zstandard.ZstdCompressor().compress(b"abc" * 1000)
    assert not jsonl.truncated_zstd(whole + whole) and jsonl.truncated_zstd(whole + whole[:-3])


def test_stream(spark, tmp_path):
    src, root, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    _write(src / "a.jsonl", [{"url": "u1", "text": "t1"}, {"url": "u2", "text": "t2"}])
    ingest_stream(spark, str(src), root, mark)
    _write(src / "b.jsonl", [{"url": "u2", "text": "t2"}, {"url": "u3", "text": "t3"}])
    ingest_stream(spark, str(src), root, mark)
    ingest_stream(spark, str(src), root, mark)
    assert spark.read.parquet(f"{root}/docs").count() == 3


def test_lookups(spark):
    df = spark.createDataFrame([("a", "error", 1, True), ("a", "success", 2, True), ("b", "success", 3, False)], "subgraph_id string, status string, seq int, k boolean").withColumn("qa", F.struct(F.col("k").alias("keep")))
    assert [r[0] for r in lookups.latest_kept(df, "qa").select("subgraph_id").collect()] == ["a"]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, seq int")
    done = lambda *x: spark.createDataFrame([(i, "success") for i in x], "id string, status string")
    assert [r[0] for r in lookups.todo(rows, done("a"), "id", limit=2).collect()] == ["b"]
    assert lookups.todo(rows, done("a", "b"), "id", limit=2).count() == 0
    assert lookups.quotas(17, 8) == [3, 2, 2, 2, 2, 2, 2, 2]
    with pytest.raises(ValueError):
        lookups.require_unique(df, "subgraph_id")
    k = spark.sql("select 'x' doc_b, named_struct('conflict_edge', named_struct('src_doc_id', 'b', 'dst_doc_id', 'a')) provenance union all select '', null")
    assert [tuple(r) for r in lookups.known_pairs(k.select("provenance")).collect()] == [("a", "b")]
    tax = spark.createDataFrame([([{"name": "D", "fields": [{"name": "F", "subfields": [{"name": "S"}, {"name": "T"}]}]}],)], "disciplines array<struct<name:string,fields:array<struct<name:string,subfields:array<struct<name:string>>>>>>")
    assert sorted(r["path"] for r in lookups.load_taxonomy(tax).collect()) == ["D -> F -> S", "D -> F -> T"]


def _anchors(spark, rows):
    cols = "doc_id string, kp_key string, subject string, slot string, confidence double, tokens array<string>, dates array<string>, numbers array<string>, source_domain string, alias_scope string, seq long"
    return spark.createDataFrame([(d, kp, s, slot, 0.9, t, dates, [], dom, "all", i) for i, (d, kp, s, slot, t, dates, dom) in enumerate(rows)], cols)


def test_two_routes(spark):
    an = _anchors(spark, [("a", "k", "p", "votes", ["x", "y"], ["2001"], "s1"), ("b", "k", "p", "votes", ["x", "z"], ["2002"], "s2"), ("c", "o", "p", "date", ["x"], [], "s3")])
    m = K.members(K.routes(an))
    s = {r["route"]: r for r in K.bucket_stats(m).collect()}
    assert s["kp"]["unbounded_pairs"] + s["ner"]["unbounded_pairs"] == 4 and s["kp"]["eligible_pairs"] + s["ner"]["eligible_pairs"] == 3
    got = {(r["doc_a"], r["doc_b"]): list(r["retrieval_signals"]) for r in K.build_candidates(an).collect()}
    assert got == {("a", "b"): ["same_kp_subject_slot"], ("a", "c"): ["tner_cross_kp_entity"], ("b", "c"): ["tner_cross_kp_entity"]}


def test_near_duplicates_and_bound(spark):
    an = _anchors(spark, [(f"d{i}", "k", "p", "votes", ["x", f"t{i % 3}", f"u{i}"], [str(i)], "") for i in range(8)])
    n = K.build_candidates(an, K.CandidateConfig(all_pairs_max_docs=3, support_top_k=1, conflict_top_k=1, candidate_pool_size=3)).count()
    assert 0 < n < 28
    same = _anchors(spark, [(d, "k", "p", "votes", ["x", "y"], ["1"], "") for d in "ab"])
    assert K.build_candidates(same).count() == 0


def test_subgraph(spark):
    rows = [("p1", "a", "b", "success", "conflict", 0.9, 1), ("p2", "a", "c", "success", "support", 0.8, 2), ("p3", "b", "d", None, "support", 0.7, 3), ("p4", "e", "f", "success", "conflict", 1.0, 4)]
    df = spark.createDataFrame(rows, "pair_id string, doc_a_id string, doc_b_id string, status string, relation string, confidence double, seq long")
    r = relations.usable_relations(df)
    g = relations.subgraphs(r).collect()
    assert len(g) == 1 and list(g[0]["node_ids"]) == ["a", "b", "c", "d"] and list(g[0]["support_edges"]) == ["p2", "p3"]
    docs = spark.createDataFrame([(d, d, d) for d in "abcd"], "doc_id string, url string, text string")
    assert len(relations.attach_documents(relations.subgraphs(r), docs).first()["documents"]) == 4
    with pytest.raises(ValueError):
        relations.attach_documents(relations.subgraphs(r), docs.where("doc_id <> 'd'"))


def test_scores_and_oracle(spark):
    items = spark.createDataFrame([("1",), ("2",), ("3",)], "benchmark_id string")
    res = spark.createDataFrame([("1", "success", "complete"), ("2", "success", "partial")], "benchmark_id string, status string, label string")
    r = evaluation.summarize(items, res).first()
    assert (r["complete"], r["partial"], r["failed"], r["k_rate"], r["missing_or_error"]) == (1, 1, 1, 0.5, 1)
    with pytest.raises(ValueError):
        evaluation.guard_results(items, res.unionByName(res))
    two = spark.createDataFrame([("1",), ("2",)], "benchmark_id string")
    runs = spark.createDataFrame([("x", "1", "complete"), ("x", "2", "failed"), ("y", "2", "complete"), ("y", "1", "partial")], "model string, benchmark_id string, label string")
    assert [(c["added"], c["c_rate"]) for c in evaluation.oracle_curve(two, runs).orderBy("models").collect()] == [("x", 0.5), ("y", 1.0)]


def test_dataset(spark):
    item = lambda i, g, q: (i, g, {"question": q, "gold_answers": [{"value": "a"}, {"value": "b"}], "preferred_answer": "a"})
    u = lambda n: f"00000000-0000-5000-8000-{n:012d}"
    df = spark.createDataFrame([(*item(u(1), u(9), "Q one"), 1), (*item(u(1), u(9), "q  ONE"), 2), (*item("bad", u(8), "q2"), 3)], "benchmark_id string, item_group_id string, eval struct<question:string,gold_answers:array<struct<value:string>>,preferred_answer:string>, line long")
    errors = sorted((r["line"] or 0, r["error"]) for r in evaluation.dataset_errors(df).collect())
    assert [e[0] for e in errors] == [0, 2, 2, 3] and "fewer than two" in errors[0][1] and errors[3][1] == "benchmark_id must be a canonical UUID string"
    assert not evaluation.dataset_report(df).first()["valid"]


def test_validators(spark):
    sql = """select named_struct('gold_answers', array(named_struct('value', '12'), named_struct('value', '30'))) qa, array(named_struct('doc_id', 'd', 'text', 'It got 12 votes, not 30.')) documents,
        named_struct('keep', true, 'verdict', 'verified', 'same_subject', true, 'same_attribute', true, 'same_fact_context', true, 'qa_valid', true, 'reason', 'r', 'answer_verifications', array(
            named_struct('value', '12', 'supported', true, 'evidence_spans', array(named_struct('doc_id', 'd', 'quote', '{q}')), 'reason', 'x', 'verified', true, 'sources', array(named_struct('source_id', 's', 'quote', '12 votes'))),
            named_struct('value', '30', 'supported', true, 'evidence_spans', array(named_struct('doc_id', 'd', 'quote', 'not 30')), 'reason', 'x', 'verified', true, 'sources', array(named_struct('source_id', 's', 'quote', 'not 30'))))) v,
        array(named_struct('source_id', 's', 'urls', array('//a/'), 'text', 'It got 12 votes, not 30.')) fetched, array('{u}') seeds"""
    ok, bad = spark.sql(sql.format(q="12 votes", u="//b/")), spark.sql(sql.format(q="thirteen votes", u="//a/"))
    get = lambda df, c: df.select(c.alias("e")).first()["e"]
    assert get(ok, validators.source_errors("v", "qa", "documents")) == []
    assert "answer verification 0 evidence is not verbatim" in get(bad, validators.source_errors("v", "qa", "documents"))
    assert get(ok, validators.web_errors("v", "qa", "fetched", "seeds")) == []
    assert "answer verification 0 reuses a seed document as independent evidence" in get(bad, validators.web_errors("v", "qa", "fetched", "seeds"))


def test_export(spark):
    qa = "named_struct('keep', true, 'questions', array(named_struct('formulation', 'named_entity', 'question', 'n'), named_struct('formulation', 'clue_based', 'question', 'c')), 'gold_answers', array(named_struct('value', 'x'), named_struct('value', 'y')), 'preferred_answer', 'x')"
    one = lambda name, body: spark.sql(f"select 's1' subgraph_id, 'success' status, 1 seq, {body} {name}")
    keep = "named_struct('keep', true, 'verdict', 'verified')"
    r = export.export_records(one("qa", qa), one("validation", keep), one("verification", keep)).collect()
    assert len(r) == 2 and len({x["item_group_id"] for x in r}) == 1 and {x["eval"]["question"] for x in r} == {"n", "c"}


def test_responder_retry(spark):
    tasks = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "key string, prompt string")
    answers = spark.createDataFrame([("a", 1, '{"v": 1}'), ("b", 1, '{"v": -1}'), ("b", 2, '{"v": 2}')], "key string, attempt int, response string")
    parse = lambda c: F.from_json(evaluation.json_object(c), "v int")
    check = lambda df: F.array_compact(F.array(F.when(F.col("value.v") < 0, "negative")))
    got = {r["key"]: (r["status"], r["rounds"]) for r in responders.run_stage(tasks, responders.replay(answers), parse, check).collect()}
    assert got == {"a": ("success", 1), "b": ("success", 2), "c": ("error", 2)}
    assert responders.message_text({"content": [{"text": "a"}, {"text": "b"}]}) == "ab" and responders.parse_headers(["A: b", "C=d: e=f ", " G =h"]) == {"A": "b", "C": "d: e=f ", "G": "h"}
    for bad in ("nothing", "=x", " : y"):
        with pytest.raises(ValueError):
            responders.parse_headers([bad])


def test_prompts_and_cache(spark):
    import contextlib

    from contrasto.operators import mentions, web

    ev = F.struct(F.lit("q").alias("question"), F.array(F.struct(F.lit("a").alias("value"))).alias("gold_answers"))
    got = spark.range(1).select(evaluation.judge_prompt(F.lit("m"), ev).alias("p"), mentions.tag_prompt(F.lit("u"), mentions.sentences(F.lit("One. Two.")), "{}").alias("t")).first()
    assert json.loads(got["p"]) == {"question": "q", "verified_answers": ["a"], "model_answer": "m"} and "S000002: Two." in got["t"]
    cand = spark.sql("select 'p' pair_id, 'a' doc_a, 'b' doc_b, array('s') retrieval_signals, array('x') subjects, array('y') slots")
    feats = spark.sql("select d doc_id, named_struct('kp_key', 'k', 'dates', array('1'), 'numbers', array('2')) f from (select explode(array('a', 'b')) d)")
    assert json.loads(relations.compact(cand, feats).first()["metadata"])["dates_b"] == ["1"]
    asked = spark.createDataFrame([("u1",), ("u2",), ("u1",)], "request string")
    cache = spark.createDataFrame([("u2", "old")], "request string, response string")
    out = {r["request"]: r["response"] for r in web.cached(asked, cache, web.page_responder(lambda u: {"url": u})).collect()}
    assert out == {"u1": '{"url": "u1"}', "u2": "old"}

    class Reply(contextlib.nullcontext):
        def __init__(self):
            import email

            super().__init__(self)
            self.headers = email.message_from_string("Content-Type: text/html; charset=utf-8")

        read, geturl = lambda self, n: b"<title>T</title><p>x</p>", lambda self: "https://w/"

    class Opener:
        open = lambda self, request, timeout: Reply()

    page = web.fetch_page("https://w", public=lambda u: True, opener=Opener())
    assert page["title"] == "T" and page["text"] == "T x" and page["error"] is None
    assert "not a public" in web.fetch_page("http://127.0.0.1/")["error"]


def test_judged(spark):
    items = spark.createDataFrame([(i, ("q", [("x",), ("y",)])) for i in "abcd"], "benchmark_id string, eval struct<question:string,gold_answers:array<struct<value:string>>>")
    res = spark.createDataFrame([("a", "success"), ("b", "success"), ("c", "error"), ("d", "success")], "benchmark_id string, status string")
    full = '{"credit": "full_credit", "gold_assessments": [{"covered": true}, {"covered": true}], "material_contradictions": []}'
    half = '{"credit": "full_credit", "gold_assessments": [{"covered": true}, {"covered": false}], "material_contradictions": []}'
    raw = spark.createDataFrame([("a", full), ("b", half), ("c", full)], "benchmark_id string, raw string")
    got = {r["benchmark_id"]: (r["label"], r["judge_error"]) for r in evaluation.judged(res, items, raw).collect()}
    assert got["a"] == ("complete", None) and got["b"] == ("failed", "judge credit is inconsistent with coverage") and got["c"] == (None, None) and got["d"][0] == "failed"
