"""Registered queries of sources, sinks, records and checks that the catalog has no place for, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions import entities as E
from contrasto.operators import candidates as K
from contrasto.operators import evaluation, mentions, prepare, recall, relations
from contrasto.plans import catalog
from contrasto.plans.registry import joined, query, table
from contrasto.sources import adapters as A
from contrasto.sources import jsonl, lookups, store
from contrasto.sources.tables import shared_dir

# ---- sources and sinks


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, source, md5(coalesce(text, '')) AS digest, text IS NULL AS missing FROM documents")
def s1_s3_s21_zstd_lines(spark, sf_dir):
    """Documents written as zstd JSON lines, in two calls, and read back strictly."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _folder(spark, "zstd")
    d = d.repartition(spark.sparkContext.defaultParallelism)
    jsonl.write_jsonl(d.where("doc_id < 50"), path, compressed=True)
    jsonl.write_jsonl(d.where("doc_id >= 50"), path, compressed=True, append=True)
    return jsonl.read_jsonl(spark, f"{path}/*.zstd", "doc_id long, text string, source string").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.col("text").isNull().alias("missing"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS numbered FROM documents")
def s2_split_lines(spark, sf_dir):
    """Plain JSON lines read in splits of 64 KB; numbers of lines are 1 to the lines of each file."""
    path = _folder(spark, "plain")
    jsonl.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text").repartition(3), path)
    rows = jsonl.read_lines(spark, f"{path}/*.json", split_bytes=1 << 16)
    files = rows.groupBy("file").agg((F.count_distinct("line") == F.max("line")).alias("numbered"))  # three rows
    r = rows.join(F.broadcast(files), "file").select(F.from_json("value", "doc_id long, text string").alias("r"), "numbered")
    return r.select("r.doc_id", F.md5(F.coalesce("r.text", F.lit(""))).alias("digest"), "numbered")


@query("SELECT doc_id, 'shard_' || lpad(CAST(doc_id AS STRING), 8, '0') AS shard FROM documents")
def s9_shard_ids(spark, sf_dir):
    name = F.concat(F.lit("/data/part/shard_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".kp.jsonl.zstd"))
    return table(spark, sf_dir, "documents").select("doc_id", jsonl.shard_id(name).alias("shard"))


@query("SELECT count(*) AS documents, CAST((SELECT count(DISTINCT source) FROM documents) AS BIGINT) AS shards, CAST((SELECT count(*) FROM documents) AS BIGINT) AS rows_seen, CAST((SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS BIGINT) AS missing_url_or_text FROM (SELECT DISTINCT doc_id FROM documents WHERE coalesce(text, '') <> '') d")
def a16_store_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("canonical_doc_id"), F.lit("u").alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    return store.totals(store.first_rows(d, ["source"]), store.ledger(d, "source"))


@query("SELECT DISTINCT concat(r_name, ' -> ', n_name, ' -> ', c_mktsegment) AS path, r_name AS discipline, n_name AS field, c_mktsegment AS subfield FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def s10_s15_taxonomy(spark, sf_dir):
    """A tree of three levels from regions, nations and segments, flattened again."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    fields = rows.groupBy("r_name", "n_name").agg(F.collect_set(F.struct(F.col("c_mktsegment").alias("name"))).alias("subfields"))
    tree = fields.groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "subfields")).alias("fields")).agg(F.collect_list(F.struct(F.col("r_name").alias("name"), "fields")).alias("disciplines"))
    return lookups.load_taxonomy(tree)


@query("SELECT CAST(user_id AS STRING) AS document_id, arg_max(CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END, event_id) AS entity FROM events GROUP BY user_id")
def s11_latest_entities(spark, sf_dir):
    """The last row of a document counts; a missing list is one without entities."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_id"), F.when(F.col("event_id") % 9 != 0, F.array("event_type")).alias("entities"), F.struct("event_id", F.lit(0)).alias("line"))
    return prepare.latest_entities(e, ["document_id"], "line").select("document_id", F.coalesce(F.array_join("entities", "|"), F.lit("")).alias("entity"))


@query("SELECT 'shard_' || lpad(CAST(n_nationkey AS STRING), 8, '0') AS shard_id, n_name || '.kp' AS tags, n_name || '.ner' AS entities FROM nation")
def s11_shard_pairs(spark, sf_dir):
    side = lambda end: table(spark, sf_dir, "nation").select(F.concat(F.lit("shard_"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0")).alias("shard_id"), F.concat("n_name", F.lit(end)).alias("file"))
    return lookups.match_shards(side(".kp"), side(".ner"))


@query("SELECT o_orderkey FROM orders")
def s16_s20_unique_keys(spark, sf_dir):
    return lookups.require_unique(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, dense_rank() OVER (ORDER BY source) AS s, (SELECT count(DISTINCT source) FROM documents) AS n FROM documents) d WHERE k <= 57 // n + CASE WHEN s <= 57 % n THEN 1 ELSE 0 END")
def w9_shard_quotas(spark, sf_dir):
    """The first documents of each shard, 57 in all, as evenly as possible."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("shard_id"))
    shards = sorted(r[0] for r in d.select("shard_id").distinct().collect())  # one row a shard
    return lookups.take_per_shard(d, dict(zip(shards, lookups.quotas(57, len(shards)))), order="doc_id").select("doc_id")


@query("SELECT CAST(o_orderkey AS STRING) AS key, CAST(CAST(('0x' || left(sha1(CAST(o_orderkey AS STRING)), 15)) AS UBIGINT) % 5 AS INT) AS shard FROM orders")
def f19_task_shards(spark, sf_dir):
    """Tasks in five parts, each taken by itself."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    parts = [lookups.take_shard(o, "key", k, 5).withColumn("shard", F.lit(k)) for k in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- preparation and candidates


@query("""
    SELECT c_custkey, text, norm, alias_scope, coalesce(alias_kind, '') AS alias_kind FROM (
        SELECT c_custkey, c_name || ' ' || c_mktsegment AS text, lower(c_name) || ' ' || lower(c_mktsegment) AS norm, 'all' AS alias_scope, NULL AS alias_kind FROM customer
        UNION ALL SELECT c_custkey, lower(c_mktsegment), lower(c_mktsegment), 'kp', 'person_surname' FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 'CXN', 'cxn', 'all', 'organization_acronym' FROM customer WHERE c_custkey % 2 = 1) v""")
def f17_subject_variants(spark, sf_dir):
    """People's surnames and organizations' acronyms (of three words, the last the nation)."""
    k = F.col("c_custkey")
    name, norm = F.concat("c_name", F.lit(" "), "c_mktsegment"), F.concat(F.lower("c_name"), F.lit(" "), F.lower("c_mktsegment"))
    person = F.struct(name.alias("text"), norm.alias("norm"), F.lit("person").alias("label"), F.lit(1).alias("mention_count"), F.lit(1).alias("first_start"))
    organization = F.struct(name.alias("text"), F.lit("city x-ray network").alias("norm"), F.lit("organization").alias("label"), F.lit(1).alias("mention_count"), F.lit(1).alias("first_start"))
    made = table(spark, sf_dir, "customer").select(k, norm.alias("own"), F.explode(E.subject_variants(F.when(k % 2 == 0, person).otherwise(organization), True)).alias("v"))
    return made.select("c_custkey", "v.text", F.when(F.col("v.norm") == "city x-ray network", F.col("own")).otherwise(F.col("v.norm")).alias("norm"), "v.alias_scope", F.coalesce("v.alias_kind", F.lit("")).alias("alias_kind"))


@query(f"{catalog._with(A.SPLIT_ANCHORS)} SELECT route, b1, subject, b2, doc_id, docs FROM m JOIN size USING (route, b1, subject, b2) WHERE docs > 1 AND (route <> 'ner' OR docs <= 6)")
def p5_over_frequent_entities(spark, sf_dir):
    """Entities of more documents than the bound are left out."""
    m = K.members(K.routes(A.select(spark, sf_dir, A.SPLIT_ANCHORS)))
    return K.usable(m, K.CandidateConfig(max_entity_docs=6)).select(*K.BUCKET, "doc_id", "docs")


_RECORD_SQL = f"""{catalog._TOPK_SQL}, merged AS ({catalog._MERGED}),
    refs AS (SELECT doc_id, concat_ws('~', doc_id, kp_key, CAST(CAST(round(confidence * 100) AS BIGINT) AS STRING), array_to_string(dates, ','), array_to_string(numbers, ','), source_domain) AS ref FROM f),
    scope AS (SELECT DISTINCT doc_id, subject || '/' || alias_scope AS s, subject FROM an),
    named AS (SELECT pair_id, string_agg(s, '|' ORDER BY x.subject) AS subject_structs FROM (SELECT pair_id, doc_a, unnest(string_split(subjects, '|')) AS subject FROM merged) x JOIN scope ON scope.doc_id = doc_a AND scope.subject = x.subject GROUP BY pair_id)
    SELECT pair_id, a.ref AS doc_a, b.ref AS doc_b, retrieval_signals, subject_structs AS subjects, slots, s.support_score, s.conflict_score, s.token_jaccard, s.date_mismatch FROM merged JOIN named USING (pair_id) JOIN refs a ON a.doc_id = doc_a JOIN refs b ON b.doc_id = doc_b JOIN scores s ON s.doc_a = merged.doc_a AND s.doc_b = merged.doc_b"""


@query(_RECORD_SQL)
def a3_f21_candidate_records(spark, sf_dir):
    """Whole records: references of both documents, subjects as structs, score structs."""
    flat = A.select(spark, sf_dir, A.ORDER_ANCHORS)
    reference = F.struct("doc_id", F.struct(F.col("kp_key").alias("key")).alias("knowledge_point"), "confidence", F.lit("").alias("evidence"), "dates", "numbers", "source_domain")
    r = K.build_records(flat.select("*", reference.alias("reference"), F.struct(F.col("subject").alias("norm"), "alias_scope").alias("subject_struct")), catalog._TOPK)
    ref = lambda d: F.concat_ws("~", d["doc_id"], d["knowledge_point"]["key"], F.round(d["confidence"] * 100).cast("long").cast("string"), joined(d["dates"], ","), joined(d["numbers"], ","), d["source_domain"])
    best = F.col("retrieval_scores.best_support")
    names = F.transform("subjects", lambda x: F.concat(x["norm"], F.lit("/"), x["alias_scope"]))
    return r.select("pair_id", ref(F.col("doc_a")).alias("doc_a"), ref(F.col("doc_b")).alias("doc_b"), joined("retrieval_signals").alias("retrieval_signals"), joined(names).alias("subjects"), joined("slots").alias("slots"),
                    best["support_score"].alias("support_score"), F.col("retrieval_scores.best_conflict.conflict_score").alias("conflict_score"), best["token_jaccard"].alias("token_jaccard"), best["date_mismatch"].alias("date_mismatch"))


@query(f"{catalog._TOPK_SQL}, known AS (SELECT DISTINCT left_doc, right_doc FROM ({A.KNOWN_PAIRS}) k), merged AS ({catalog._MERGED}) SELECT signal, count(*) AS recovered FROM (SELECT doc_a, doc_b, unnest(string_split(retrieval_signals, '|')) AS signal FROM merged) m JOIN known ON doc_a = left_doc AND doc_b = right_doc GROUP BY signal")
def a4_recall_by_signal(spark, sf_dir):
    return recall.recall_by_signal(K.build_candidates(A.select(spark, sf_dir, A.ORDER_ANCHORS), catalog._TOPK), catalog._known(spark, sf_dir))


@query(f"{catalog._TOPK_SQL}, merged AS ({catalog._MERGED}) SELECT left_doc, right_doc FROM (SELECT DISTINCT left_doc, right_doc FROM ({A.AUDIT_PAIRS}) k) k WHERE NOT EXISTS (SELECT 1 FROM merged WHERE doc_a = left_doc AND doc_b = right_doc) ORDER BY left_doc, right_doc LIMIT 20")
def a4_missing_examples(spark, sf_dir):
    """A report of the first twenty missing pairs."""
    got = recall.missing_examples(K.build_candidates(A.select(spark, sf_dir, A.ORDER_ANCHORS), catalog._TOPK), catalog._known(spark, sf_dir, A.AUDIT_PAIRS))
    return got.select(F.col("left").alias("left_doc"), F.col("right").alias("right_doc"))


# ---- relations, entities, prompts


@query(f"WITH {catalog._REL} SELECT r.pair_id, doc_a_id AS doc_a, doc_b_id AS doc_b, a.kp_key AS kp_a, b.numbers[1] AS number_b FROM r JOIN (SELECT doc_id, any_value(kp_key) AS kp_key FROM ({A.ORDER_ANCHORS}) x GROUP BY doc_id) a ON a.doc_id = doc_a_id JOIN (SELECT doc_id, any_value(numbers) AS numbers FROM ({A.ORDER_ANCHORS}) x GROUP BY doc_id) b ON b.doc_id = doc_b_id")
def f22_compact_tasks(spark, sf_dir):
    r = relations.usable_relations(A.select(spark, sf_dir, A.RELATIONS)).select("pair_id", F.col("doc_a_id").alias("doc_a"), F.col("doc_b_id").alias("doc_b"), F.array(F.lit("s")).alias("retrieval_signals"), F.array(F.lit("x")).alias("subjects"), F.array(F.lit("y")).alias("slots"))
    made = relations.compact(r, K.features(A.select(spark, sf_dir, A.ORDER_ANCHORS)))
    return made.select("pair_id", "doc_a", "doc_b", F.get_json_object("metadata", "$.knowledge_point_a").alias("kp_a"), F.get_json_object("metadata", "$.numbers_b[0]").alias("number_b"))


@query(f"""WITH {catalog._REL}, {catalog._ENDS}, picked AS (SELECT s.pair_id, s.doc_a_id, s.doc_b_id, from_id, to_id, row_number() OVER (PARTITION BY s.pair_id, side ORDER BY trust DESC, edge) AS k FROM seed s JOIN (SELECT 0 AS side UNION ALL SELECT 1) d ON true JOIN ends ON endpoint = CASE WHEN side = 0 THEN doc_a_id ELSE doc_b_id END WHERE least(n_a, n_b) >= 1),
    nodes AS (SELECT DISTINCT pair_id, unnest([doc_a_id, doc_b_id, from_id, to_id]) AS node FROM picked WHERE k <= 2)
    SELECT concat('subgraph-', pair_id) AS subgraph_id, string_agg(document_id || md5(evidence) || url, '|' ORDER BY document_id) AS documents FROM nodes JOIN ({A.ORDER_EVIDENCE}) e ON document_id = node GROUP BY pair_id""")
def j10_s13_subgraph_documents(spark, sf_dir):
    r = relations.usable_relations(A.select(spark, sf_dir, A.RELATIONS))
    docs = A.select(spark, sf_dir, A.ORDER_EVIDENCE).select(F.col("document_id").alias("doc_id"), "url", F.col("evidence").alias("text"))
    made = relations.attach_documents(relations.subgraphs(r), docs)
    return made.select("subgraph_id", joined(F.transform("documents", lambda d: F.concat(d["doc_id"], F.md5(d["text"]), d["url"]))).alias("documents"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[.] ([A-Z][a-z]+)', 1)) AS t FROM documents)
    SELECT doc_id, norm, CAST(count(*) AS INT) AS n FROM (SELECT doc_id, t, lower(t) AS norm FROM w WHERE length(t) % 2 = 1) x WHERE length(norm) >= 2 AND norm NOT IN (""" + catalog.quoted(C.NAVIGATION_WORDS) + """) GROUP BY ALL""")
def x5_p15_batched_entities(spark, sf_dir):
    """First words of sentences labelled by batches of windows; only one of the two labels is allowed, and what two windows find counts once."""
    def labeller():
        word = re.compile(r"(?<=[.] )[A-Z][a-z]+")
        return lambda texts: [[(m.start(), m.end(), "B-LOC" if len(m[0]) % 2 else "B-PER") for m in word.finditer(t)] for t in texts]

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    windows = mentions.chunk_documents(d)
    found = mentions.label_windows(windows, labeller)
    texts = windows.select("document_id", F.col("chunk_start").alias("window"), F.col("chunk_text").alias("text"))
    spans = mentions.decode_mentions(found.withColumn("window", F.col("chunk_start")), ["document_id", "window"], ["location"], texts)
    whole = spans.dropDuplicates(["document_id", "start", "end"])
    return whole.groupBy(F.col("document_id").cast("long").alias("doc_id"), "norm").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT o_orderkey, '{"question":"Who is ' || o_orderkey || '","verified_answers":["a","b"],"model_answer":"m"}' AS prompt FROM orders""")
def f34_judge_prompts(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    ev = F.struct(F.concat(F.lit("Who is "), k).alias("question"), F.array(F.struct(F.lit("a").alias("value")), F.struct(F.lit("b").alias("value"))).alias("gold_answers"))
    return table(spark, sf_dir, "orders").select("o_orderkey", evaluation.judge_prompt(F.lit("m"), ev).alias("prompt"))
