"""The registered queries, each with its DuckDB SQL where SQL can express it.

Column types agree on both sides: strings, bigint, double (rounded) and boolean; arrays are joined by ``|``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions import entities as E
from contrasto.functions import text as T
from contrasto.operators import candidates as K
from contrasto.operators import evaluation, export, mentions, prepare, recall, relations, responders, validators, web
from contrasto.plans.registry import ORACLE_SQL, QUERIES, joined, query, quoted, table
from contrasto.sources import adapters as A
from contrasto.sources import jsonl, lookups, store

# ---- sources, identifiers, text functions


@query(f"SELECT CASE WHEN given_id <> '' THEN given_id ELSE sha1(concat(url, chr(10), text)) END AS document_id, url FROM ({A.RAW_DOCUMENTS}) r")
def s7_document_id(spark, sf_dir):
    r = A.select(spark, sf_dir, A.RAW_DOCUMENTS)
    raw = r.select("url", "text", F.lit(None).cast("string").alias("content"), F.col("given_id").alias("document_id"), F.lit("").alias("doc_id"), F.lit(None).cast("struct<url:string,text:string>").alias("source_record"))
    return raw.select(jsonl.document_id().alias("document_id"), jsonl.extract_url().alias("url"))


@query(f"""
    SELECT canonical_doc_id, url, length(text) AS n_chars FROM (
        SELECT *, row_number() OVER (PARTITION BY canonical_doc_id ORDER BY seq) AS k FROM (
            SELECT CASE WHEN given_id <> '' THEN given_id ELSE sha1(concat(url, chr(10), text)) END AS canonical_doc_id, url, text, seq FROM ({A.RAW_DOCUMENTS}) r WHERE text <> '') x) y
    WHERE k = 1""")
def s8_document_store(spark, sf_dir):
    r = A.select(spark, sf_dir, A.RAW_DOCUMENTS)
    rows = r.select("seq", F.coalesce(F.nullif("given_id", F.lit("")), F.sha1(F.concat("url", F.lit("\n"), "text"))).alias("canonical_doc_id"), "url", "text")
    return store.first_rows(rows, ["seq"]).select("canonical_doc_id", "url", F.length("text").cast("long").alias("n_chars"))


@query("SELECT source AS shard, count(*) AS rows_seen, count(*) FILTER (WHERE coalesce(text, '') = '') AS missing_url_or_text FROM documents GROUP BY source")
def s8_shard_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.lit("u").alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    return store.ledger(d, "source")


@query(f"SELECT DISTINCT left_doc, right_doc FROM ({A.KNOWN_PAIRS}) k")
def s17_known_pairs(spark, sf_dir):
    k = A.select(spark, sf_dir, A.KNOWN_PAIRS)
    # both directions and an aliased shape, to be made one again
    both = k.select(F.col("right_doc").alias("src_doc_id"), F.col("left_doc").alias("dst_doc_id")).unionByName(k.select(F.col("left_doc").alias("src_doc_id"), F.col("right_doc").alias("dst_doc_id")))
    return lookups.known_pairs(both).select(F.col("left").alias("left_doc"), F.col("right").alias("right_doc"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def f1_normalize_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_space("text")).alias("digest"))


@query("SELECT doc_id, left(sha1(text), 16) AS h, sha256(source) AS key FROM documents")
def f4_f5_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_hash("text").alias("h"), F.sha2("source", 256).alias("key"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS domain FROM pages")
def f6_source_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.source_domain("url").alias("domain"))


@query("""
    SELECT page_id, concat('//', lower(host), CASE WHEN port <> '' AND NOT (lower(scheme) = 'http' AND port = '80') AND NOT (lower(scheme) = 'https' AND port = '443') THEN ':' || port ELSE '' END,
           CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END, CASE WHEN q <> '' THEN '?' || q ELSE '' END) AS url
    FROM (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '//([^/?#:]*)', 1) AS host, regexp_extract(url, '//[^/?#:]*:([0-9]+)', 1) AS port,
                 regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages) u""")
def f7_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url("url").alias("url"))


_SLOTS_SQL = ", ".join(f"CASE WHEN regexp_matches(evidence, '(?i)\\b(?:{w})\\b') THEN '{n}' END" for n, w in C.SLOT_WORDS.items())


@query(f"SELECT document_id, array_to_string(list_filter([{_SLOTS_SQL}], lambda x: x IS NOT NULL), '|') AS slots FROM ({A.ORDER_EVIDENCE}) e")
def f8_extract_slots(spark, sf_dir):
    return A.select(spark, sf_dir, A.ORDER_EVIDENCE).select("document_id", joined(T.extract_slots("evidence")).alias("slots"))


@query(f"""SELECT document_id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), '|') AS dates
    FROM (SELECT document_id, list_transform(regexp_extract_all(evidence, '\\b(?:18|19|20)\\d{{2}}(?:[-/]\\d{{1,2}}(?:[-/]\\d{{1,2}})?)?\\b'), lambda x: lower(x)) AS d FROM ({A.ORDER_EVIDENCE}) e) z""")
def f9_extract_dates(spark, sf_dir):
    return A.select(spark, sf_dir, A.ORDER_EVIDENCE).select("document_id", joined(T.extract_dates("evidence")).alias("dates"))


# SQL has no look-behind: the character before a number is matched with it; numbers are at most one character apart from it
@query(f"""SELECT document_id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i)[1:16], '|') AS numbers
    FROM (SELECT document_id, list_transform(regexp_extract_all(' ' || evidence, '(?i)[^\\w.]({C.NUMBER_PATTERN.split(')', 1)[1]})', 1), lambda x: replace(lower(x), ',', '')) AS d FROM ({A.ORDER_EVIDENCE}) e) z""")
def f10_extract_numbers(spark, sf_dir):
    return A.select(spark, sf_dir, A.ORDER_EVIDENCE).select("document_id", joined(T.extract_numbers("evidence")).alias("numbers"))


@query(f"""
    SELECT concat('d', CAST(doc_id AS STRING)) AS document_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN (
        SELECT doc_id, string_agg(w, '|' ORDER BY k) AS tokens FROM (
            SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM (
                SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_''-]{{1,}}'), lambda x: lower(x))) AS w FROM documents) a
                WHERE length(w) > 2 AND w NOT IN ({quoted(C.STOPWORDS)}) GROUP BY ALL) b) c
        WHERE k <= 64 GROUP BY doc_id) t USING (doc_id)""")
def f11_content_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), joined(T.content_tokens("text")).alias("tokens"))


@query("""
    SELECT c_custkey, regexp_replace(lower(n), '^(the|a|an)\\s+', '') AS subject, regexp_replace(lower(n), chr(39) || 's\\b', '') AS entity, true AS reasonable
    FROM (SELECT c_custkey, concat('The ', c_name, chr(39), 's ', c_mktsegment) AS n FROM customer) c""")
def f3_f26_entity_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("The "), "c_name", F.lit("'s "), "c_mktsegment", F.lit(" "))
    return c.select("c_custkey", T.normalize_subject(name).alias("subject"), E.normalize_entity(name).alias("entity"), E.reasonable_entity(name, E.normalize_entity(name)).alias("reasonable"))


@query(f"""
    SELECT doc_a, doc_b, concat('pair-', left(sha1(least(doc_a, doc_b) || chr(0) || greatest(doc_a, doc_b)), 20)) AS pair_id
    FROM (SELECT document_id AS doc_a, lead(document_id) OVER (PARTITION BY customer ORDER BY seq) AS doc_b FROM ({A.ORDER_EVIDENCE}) e) p WHERE doc_b IS NOT NULL""")
def f18_pair_id(spark, sf_dir):
    """A customer's orders with the next one each."""
    e = A.select(spark, sf_dir, A.ORDER_EVIDENCE)
    p = e.select(F.col("document_id").alias("doc_a"), F.lead("document_id").over(W.partitionBy("customer").orderBy("seq")).alias("doc_b")).where("doc_b is not null")
    return p.select("doc_a", "doc_b", T.pair_id("doc_a", "doc_b").alias("pair_id"))


@query("SELECT c_custkey FROM customer WHERE CAST(('0x' || left(sha1(c_name), 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0 < 0.25")
def x1_hash_sample(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(T.unit_interval("c_name") < 0.25).select("c_custkey")


_STRIPPED = "regexp_replace({}, '^[\\t-\\r \\p{{Z}}]+|[\\t-\\r \\p{{Z}}]+$', '', 'g')"
# the places where sentences end are marked first, since SQL has no look-behind
_SENTENCES = f"""
    SELECT doc_id, list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'),
               '([。！？；;])[\\t-\\r \\p{{Z}}]*', '\\1' || chr(1), 'g'), '([.!?])[\\t-\\r \\p{{Z}}]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: {_STRIPPED.format('x')}), lambda x: x <> ''),
           lambda x: list_transform(range(0, CAST(ceil(length(x) / 1200.0) AS BIGINT)), lambda k: {_STRIPPED.format('substring(x, k * 1200 + 1, 1200)')}))), lambda x, i: {{'n': i, 'sentence': x}}), lambda x: x.sentence <> '') AS s FROM documents"""


@query(f"SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(list_transform(s, lambda x: printf('S%06d: %s', x.n, x.sentence)), chr(10))) AS digest FROM ({_SENTENCES}) d")
def f23_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", mentions.sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.md5(mentions.visible_text("s")).alias("digest"))


_PLAIN = "replace(replace(replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"""
    SELECT page_id, title, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM (
        SELECT page_id, trim(regexp_replace({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title,
               array_to_string(list_filter(list_transform(string_split({_PLAIN.format("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '</(p|div|li|br|h1|h2|h3|tr|section)>', chr(10), 'g'), '<[^>]*>', ' ', 'g')")},
                   chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM pages) p""")
def s27_page_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", web.page_text("html").alias("p"))
    return p.select("page_id", "p.title", F.length("p.text").alias("n_chars"), F.md5("p.text").alias("digest"))


@query("""SELECT q, CAST(rank AS INT) AS rank, 'Tom & ' || url AS title, url, 'a b' AS snippet FROM (
    SELECT page_id % 20 AS q, url, row_number() OVER (PARTITION BY page_id % 20 ORDER BY url) AS rank FROM (SELECT DISTINCT page_id % 20 AS page_id, url FROM pages) d) r WHERE rank <= 5""")
def s26_search_results(spark, sf_dir):
    item = F.struct(F.concat(F.lit("Tom &amp; "), "url").alias("title"), "url", F.lit("a  b").alias("description"))
    p = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 20).alias("q")).agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(item)).alias("results")).alias("web"))).alias("payload"))
    return web.search_results(p, ["q"])


# ---- preparation


def _tag_rows(spark, sf_dir):
    e = A.select(spark, sf_dir, A.ORDER_EVIDENCE)
    second = F.struct(F.lit(0.5).alias("confidence"), F.lit("Other").alias("discipline"), F.lit("Other").alias("field"), F.lit("Other").alias("subfield"), F.lit("").alias("evidence"))
    first = F.struct("confidence", "discipline", "field", "subfield", "evidence")
    tags = e.select("document_id", "language", F.lit(True).alias("is_knowledge_bearing"), F.array(second, first).alias("tags"), "url", "seq")
    none = F.lit(None).cast("array<string>")
    who = F.struct(F.col("customer").alias("text"), F.lower("customer").alias("norm"), F.lit("person").alias("label"), F.lit(1).alias("count"), F.lit(13).alias("first_start"), none.alias("surface_forms"))
    where = F.struct(F.col("field").alias("text"), F.lower("field").alias("norm"), F.lit("location").alias("label"), F.lit(2).alias("count"), F.lit(0).alias("first_start"), none.alias("surface_forms"))
    return tags, e.select("document_id", F.when(F.col("seq") % 23 == 0, F.array().cast("array<struct<text:string,norm:string,label:string,count:int,first_start:int,surface_forms:array<string>>>")).otherwise(F.array(who, where)).alias("entities"))


_REASON = """CASE WHEN language NOT IN ('', 'en') THEN 'wrong_language' WHEN confidence < 0.9 THEN 'low_confidence' WHEN length(evidence) < 60 THEN 'short_evidence' WHEN seq % 23 = 0 THEN 'missing_subject' ELSE 'kept' END"""


@query(f"SELECT document_id, {_REASON} AS reason FROM ({A.ORDER_EVIDENCE}) e")
def p1_preparation_reasons(spark, sf_dir):
    return prepare.signals(*_tag_rows(spark, sf_dir)).select("document_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"""
    SELECT document_id AS doc_id, lower(concat(discipline, chr(9), field, chr(9), subfield)) AS kp_key, round(confidence, 6) AS confidence, s.subject, t.slot, regexp_replace(regexp_extract(url, '//([^/]*)', 1), '^www\\.', '') AS source_domain
    FROM ({A.ORDER_EVIDENCE}) e CROSS JOIN (SELECT unnest(['date', 'price', 'rank']) AS slot) t CROSS JOIN LATERAL (SELECT unnest([lower(e.customer), lower(e.field)]) AS subject) s
    WHERE {_REASON} = 'kept'""")
def d8_anchors(spark, sf_dir):
    tags, ner = _tag_rows(spark, sf_dir)
    made = prepare.anchors(prepare.signals(tags, ner), tags.select("document_id", T.source_domain("url").alias("source_domain")))
    return made.select("doc_id", F.col("knowledge_point.key").alias("kp_key"), "confidence", F.col("subject.norm").alias("subject"), "slot", "source_domain")


@query(f"""SELECT count(*) AS input_rows, 0 AS missing_ner, count(*) FILTER (WHERE {_REASON} = 'kept') AS documents_with_anchors, 6 * count(*) FILTER (WHERE {_REASON} = 'kept') AS anchors,
    (SELECT string_agg(reason || '=' || n, '|' ORDER BY reason) FROM (SELECT {_REASON} AS reason, count(*) AS n FROM ({A.ORDER_EVIDENCE}) x GROUP BY ALL) y WHERE reason <> 'kept') AS reasons FROM ({A.ORDER_EVIDENCE}) e""")
def a8_manifest(spark, sf_dir):
    rows = prepare.signals(*_tag_rows(spark, sf_dir))
    made = prepare.manifest(rows, prepare.anchors(rows))
    return made.withColumn("reasons", joined(F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))))


# ---- candidate pairs

_MEMBERS = """
    SELECT 'kp' AS route, kp_key AS b1, subject, slot AS b2, doc_id, kp_key, slot, confidence, seq FROM an
    UNION ALL SELECT * FROM (SELECT 'ner' AS route, '' AS b1, subject, '' AS b2, doc_id, kp_key, slot, confidence, seq FROM an WHERE alias_scope <> 'kp' QUALIFY row_number() OVER (PARTITION BY subject, doc_id ORDER BY confidence DESC, seq) = 1)"""


def _with(anchors: str) -> str:
    return f"WITH an AS ({anchors}), m AS ({_MEMBERS}), size AS (SELECT route, b1, subject, b2, count(*) AS docs FROM m GROUP BY ALL)"


_FIRSTS = "SELECT route, b1, subject, b2, doc_id, arg_min(seq, (-confidence, seq)) AS seq FROM m GROUP BY ALL"


@query(f"{_with(A.SPLIT_ANCHORS)} {_FIRSTS}")
def a1_bucket_members(spark, sf_dir):
    return K.members(K.routes(A.select(spark, sf_dir, A.SPLIT_ANCHORS))).select(*K.BUCKET, "doc_id", "seq")


@query(f"""{_with(A.SPLIT_ANCHORS)}, by_kp AS (SELECT route, b1, subject, b2, kp_key, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT route, b1, subject, b2, sum(n) AS docs, sum(n * (n - 1) // 2) AS same_kp FROM by_kp GROUP BY ALL)
    SELECT route, count(*) AS buckets, CAST(sum(docs) AS BIGINT) AS members, CAST(max(docs) AS BIGINT) AS max_bucket_docs, count(*) FILTER (WHERE docs = 1) AS singletons, CAST(sum(docs * (docs - 1) // 2) AS BIGINT) AS unbounded_pairs,
           CAST(sum(same_kp) AS BIGINT) AS same_kp_pairs, CAST(sum(docs * (docs - 1) // 2 - CASE WHEN route = 'ner' THEN same_kp ELSE 0 END) AS BIGINT) AS eligible_pairs, count(*) FILTER (WHERE route = 'ner' AND docs > 200000) AS over_frequent, count(*) FILTER (WHERE docs > 5000) AS split_buckets
    FROM s GROUP BY route""")
def a2_bucket_stats(spark, sf_dir):
    return K.bucket_stats(K.members(K.routes(A.select(spark, sf_dir, A.SPLIT_ANCHORS))))


_SCORES = """
    SELECT doc_a, doc_b, jac AS token_jaccard, date_mismatch, number_mismatch, same_source_domain,
           round(6 * j + trust + bonus + CASE WHEN same_values THEN 1 ELSE 0 END, 6) AS support_score, round(6 * j + trust + bonus + CASE WHEN date_mismatch THEN 2 ELSE 0 END + CASE WHEN number_mismatch THEN 1.5::DOUBLE ELSE 0 END, 6) AS conflict_score, near
    FROM (SELECT *, round(j, 6) AS jac, j >= 0.95 AND same_dates AND same_numbers AS near, same_dates AND same_numbers AS same_values, NOT same_dates AS date_mismatch, NOT same_numbers AS number_mismatch FROM (
        SELECT doc_a, doc_b, len(list_intersect(x.tokens, y.tokens))::DOUBLE / len(list_distinct(list_concat(x.tokens, y.tokens))) AS j, sqrt(x.confidence * y.confidence) AS trust, CASE WHEN x.source_domain = y.source_domain THEN -0.75::DOUBLE ELSE 0.5::DOUBLE END AS bonus,
               x.source_domain = y.source_domain AS same_source_domain, list_sort(list_distinct(x.dates)) = list_sort(list_distinct(y.dates)) AS same_dates, list_sort(list_distinct(x.numbers)) = list_sort(list_distinct(y.numbers)) AS same_numbers
        FROM pairs JOIN f x ON x.doc_id = doc_a JOIN f y ON y.doc_id = doc_b) z) w"""
_FEATS = "f AS (SELECT doc_id, confidence, dates, numbers, tokens, source_domain, kp_key FROM an QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1)"
_SMALL = """
    SELECT l.route, l.b1, l.subject, l.b2, l.doc_id AS doc_a, r.doc_id AS doc_b, l.slot FROM m l JOIN m r ON l.route = r.route AND l.b1 = r.b1 AND l.subject = r.subject AND l.b2 = r.b2 AND l.doc_id < r.doc_id
    JOIN size s ON s.route = l.route AND s.b1 = l.b1 AND s.subject = l.subject AND s.b2 = l.b2 WHERE s.docs <= {most} AND (l.route = 'kp' OR l.kp_key <> r.kp_key)"""


@query(f"{_with(A.SPLIT_ANCHORS)} SELECT route, b1, subject, b2, doc_a, doc_b FROM ({_SMALL.format(most=20)}) p")
def j3_j4_all_pairs(spark, sf_dir):
    return K.bucket_pairs(A.select(spark, sf_dir, A.SPLIT_ANCHORS))


@query(f"{_with(A.ORDER_ANCHORS)}, {_FEATS}, pairs AS (SELECT DISTINCT doc_a, doc_b FROM ({_SMALL.format(most=20)}) p) SELECT * EXCLUDE (near) FROM ({_SCORES}) s")
def f16_pair_scores(spark, sf_dir):
    return K.small_scores(A.select(spark, sf_dir, A.ORDER_ANCHORS), K.CandidateConfig(near_duplicate_jaccard=2.0)).select("doc_a", "doc_b", "scores.*")


_MERGED = """
    SELECT concat('pair-', left(sha1(p.doc_a || chr(0) || p.doc_b), 20)) AS pair_id, p.doc_a, p.doc_b, string_agg(DISTINCT CASE WHEN route = 'kp' THEN 'same_kp_subject_slot' ELSE 'tner_cross_kp_entity' END, '|' ORDER BY CASE WHEN route = 'kp' THEN 'same_kp_subject_slot' ELSE 'tner_cross_kp_entity' END) AS retrieval_signals,
           string_agg(DISTINCT subject, '|' ORDER BY subject) AS subjects, coalesce(string_agg(DISTINCT CASE WHEN route = 'kp' THEN slot END, '|' ORDER BY CASE WHEN route = 'kp' THEN slot END), '') AS slots, max(nullif(support_score, 0)) AS best_support, max(nullif(conflict_score, 0)) AS best_conflict, max(token_jaccard) AS token_jaccard
    FROM chosen p JOIN scores USING (doc_a, doc_b) GROUP BY p.doc_a, p.doc_b"""


def _merged(df: DataFrame) -> DataFrame:
    return df.drop("retrieval_scores").withColumns({c: joined(c) for c in ("retrieval_signals", "subjects", "slots")})


_TOPK = K.CandidateConfig(all_pairs_max_docs=12, support_top_k=2, conflict_top_k=2, rare_tokens=3, max_token_docs=5, candidate_pool_size=4, max_chunk_docs=16, chunk_overlap=4)
# Hash order within buckets, overlapping chunks, rare-token pools, ring neighbours, top-k by either score.
def _topk_sql(c: K.CandidateConfig) -> str:
    step = max(1, c.max_chunk_docs - c.chunk_overlap)
    return f"""{_with(A.ORDER_ANCHORS)}, {_FEATS}, an_docs AS (SELECT m.*, docs, row_number() OVER (PARTITION BY route, b1, subject, b2 ORDER BY left(sha1(doc_id), 16), doc_id) - 1 AS i FROM m JOIN size USING (route, b1, subject, b2) WHERE docs > 1),
    ch AS (SELECT * EXCLUDE (i), unnest(CASE WHEN docs <= {c.max_chunk_docs} THEN [0::BIGINT] ELSE range(greatest(0, CAST(floor((i - {c.max_chunk_docs}) / {step}) AS BIGINT) + 1), CAST(floor(i / {step}) AS BIGINT) + 1) END) AS chunk FROM an_docs),
    sz AS (SELECT *, concat_ws('~', route, b1, subject, b2, chunk) AS g, count(*) OVER (PARTITION BY route, b1, subject, b2, chunk) AS n, row_number() OVER (PARTITION BY route, b1, subject, b2, chunk ORDER BY left(sha1(doc_id), 16), doc_id) - 1 AS place FROM ch),
    small AS (SELECT l.route, l.b1, l.subject, l.b2, l.doc_id AS doc_a, r.doc_id AS doc_b FROM sz l JOIN sz r ON l.g = r.g AND l.doc_id < r.doc_id WHERE l.n <= {c.all_pairs_max_docs} AND (l.route = 'kp' OR l.kp_key <> r.kp_key)),
    tk AS (SELECT g, sz.doc_id, unnest(list_distinct(f.tokens)) AS token FROM sz JOIN f ON f.doc_id = sz.doc_id WHERE n > {c.all_pairs_max_docs}), df AS (SELECT g, token, count(*) AS df FROM tk GROUP BY ALL),
    rare AS (SELECT g, token, doc_id FROM (SELECT tk.*, df, row_number() OVER (PARTITION BY g, doc_id ORDER BY df, token) AS k FROM tk JOIN df USING (g, token)) x WHERE k <= {c.rare_tokens} AND df <= {c.max_token_docs}),
    pool0 AS (SELECT DISTINCT a.g, a.doc_id, b.doc_id AS other FROM rare a JOIN rare b ON a.g = b.g AND a.token = b.token AND a.doc_id <> b.doc_id),
    pool AS (SELECT g, pool0.doc_id, other FROM pool0 JOIN f x ON x.doc_id = pool0.doc_id JOIN f y ON y.doc_id = other QUALIFY row_number() OVER (PARTITION BY g, pool0.doc_id ORDER BY len(list_intersect(x.tokens, y.tokens)) DESC, left(sha1(other), 16), other) <= {c.candidate_pool_size}),
    have AS (SELECT g, doc_id, count(*) AS have FROM pool GROUP BY ALL),
    asks AS (SELECT g, doc_id, n, place, unnest(range(1, 1 + least({c.candidate_pool_size} - coalesce(have, 0), n - 1))) AS k FROM sz LEFT JOIN have USING (g, doc_id) WHERE n > {c.all_pairs_max_docs}),
    ring AS (SELECT a.g, a.doc_id, b.doc_id AS other FROM (SELECT *, (place + CASE WHEN k % 2 = 1 THEN -((k + 1) // 2) ELSE k // 2 END + n) % n AS pos FROM asks) a JOIN sz b ON a.g = b.g AND b.place = a.pos WHERE a.doc_id <> b.doc_id),
    cand AS (SELECT c.*, s.route, s.b1, s.subject, s.b2, least(c.doc_id, other) AS doc_a, greatest(c.doc_id, other) AS doc_b FROM (SELECT * FROM pool UNION SELECT * FROM ring) c JOIN sz s ON s.g = c.g AND s.doc_id = c.doc_id JOIN sz o ON o.g = c.g AND o.doc_id = other WHERE s.route = 'kp' OR s.kp_key <> o.kp_key),
    pairs AS (SELECT doc_a, doc_b FROM small UNION SELECT doc_a, doc_b FROM cand), scores AS (SELECT * FROM ({_SCORES}) s WHERE NOT near),
    top AS (SELECT route, b1, subject, b2, doc_a, doc_b FROM cand JOIN scores USING (doc_a, doc_b) QUALIFY row_number() OVER (PARTITION BY g, doc_id ORDER BY support_score DESC, other) <= {c.support_top_k} OR row_number() OVER (PARTITION BY g, doc_id ORDER BY conflict_score DESC, other) <= {c.conflict_top_k}),
    chosen AS (SELECT u.*, m.slot FROM (SELECT * FROM small UNION SELECT * FROM top) u JOIN m ON m.route = u.route AND m.b1 = u.b1 AND m.subject = u.subject AND m.b2 = u.b2 AND m.doc_id = u.doc_a)"""


_TOPK_SQL = _topk_sql(_TOPK)


@query(f"{_TOPK_SQL} {_MERGED}")
def w1_topk_pairs(spark, sf_dir):
    return _merged(K.build_candidates(A.select(spark, sf_dir, A.ORDER_ANCHORS), _TOPK))


@query(f"{_topk_sql(K.CandidateConfig.library())} {_MERGED}")
def a3_pair_merge(spark, sf_dir):
    """The library's defaults: ten partners by either score in large buckets."""
    return _merged(K.build_candidates(A.select(spark, sf_dir, A.ORDER_ANCHORS), K.CandidateConfig.library()))


@query(f"{_topk_sql(K.CandidateConfig.command_line())} {_MERGED}")
def w1_production_pairs(spark, sf_dir):
    """The command line's defaults."""
    return _merged(K.build_candidates(A.select(spark, sf_dir, A.ORDER_ANCHORS), K.CandidateConfig.command_line()))


# ---- recall and audits


def _known(spark, sf_dir, pairs=A.KNOWN_PAIRS):
    return A.select(spark, sf_dir, pairs).select(F.col("left_doc").alias("left"), F.col("right_doc").alias("right")).distinct()


@query(f"{_TOPK_SQL}, known AS (SELECT DISTINCT left_doc, right_doc FROM ({A.KNOWN_PAIRS}) k), merged AS ({_MERGED}) SELECT count(*) AS known_pairs, count(pair_id) AS recovered_pairs, count(pair_id)::DOUBLE / count(*) AS recall FROM known LEFT JOIN merged ON doc_a = left_doc AND doc_b = right_doc")
def a4_known_pair_recall(spark, sf_dir):
    return recall.pair_recall(K.build_candidates(A.select(spark, sf_dir, A.ORDER_ANCHORS), _TOPK), _known(spark, sf_dir))


# which pairs share a subject, a slot, a bucket: joined from the pairs' own documents
_AUDIT = """, ds AS (SELECT DISTINCT doc_id, subject FROM an), dt AS (SELECT DISTINCT doc_id, slot FROM an), have AS (SELECT DISTINCT doc_id FROM an),
    hit AS (SELECT DISTINCT left_doc, right_doc FROM known, {match} WHERE {cond}),
    same_subject AS (SELECT DISTINCT left_doc, right_doc FROM known JOIN ds x ON x.doc_id = left_doc JOIN ds y ON y.doc_id = right_doc AND y.subject = x.subject),
    same_slot AS (SELECT DISTINCT left_doc, right_doc FROM known JOIN dt x ON x.doc_id = left_doc JOIN dt y ON y.doc_id = right_doc AND y.slot = x.slot)
    SELECT k.left_doc, k.right_doc, CASE WHEN h.left_doc IS NOT NULL THEN 'recovered' WHEN l.doc_id IS NULL OR r.doc_id IS NULL THEN 'endpoint_missing_anchor' WHEN s.left_doc IS NULL THEN 'no_shared_subject'
        WHEN t.left_doc IS NULL THEN 'no_shared_slot' ELSE 'no_shared_subject_slot_combination' END AS reason
    FROM known k LEFT JOIN hit h USING (left_doc, right_doc) LEFT JOIN have l ON l.doc_id = k.left_doc LEFT JOIN have r ON r.doc_id = k.right_doc LEFT JOIN same_subject s USING (left_doc, right_doc) LEFT JOIN same_slot t USING (left_doc, right_doc)"""
_KNOWN_CTE = f"known AS (SELECT DISTINCT left_doc, right_doc FROM ({A.AUDIT_PAIRS}) k)"
_BLOCK = "x.route = y.route AND x.b1 = y.b1 AND x.subject = y.subject AND x.b2 = y.b2 AND x.doc_id = left_doc AND y.doc_id = right_doc AND (x.route = 'kp' OR x.kp_key <> y.kp_key)"


@query(f"{_with(A.SPLIT_ANCHORS)}, {_KNOWN_CTE}{_AUDIT.format(match='m x, m y', cond=_BLOCK)}")
def a5_blocking_audit(spark, sf_dir):
    an = A.select(spark, sf_dir, A.SPLIT_ANCHORS)
    return recall.audit_blocking(an, _known(spark, sf_dir, A.AUDIT_PAIRS)).select(F.col("left").alias("left_doc"), F.col("right").alias("right_doc"), F.coalesce("reason", F.lit("recovered")).alias("reason"))


_PREP = "x.subject = y.subject AND x.slot = y.slot AND x.doc_id = left_doc AND y.doc_id = right_doc AND (x.kp_key = y.kp_key OR (x.alias_scope = 'all' AND y.alias_scope = 'all'))"


@query(f"{_with(A.SPLIT_ANCHORS)}, {_KNOWN_CTE}{_AUDIT.format(match='an x, an y', cond=_PREP)}")
def a6_preparation_audit(spark, sf_dir):
    an = A.select(spark, sf_dir, A.SPLIT_ANCHORS)
    return recall.audit_preparation(an, _known(spark, sf_dir, A.AUDIT_PAIRS)).select(F.col("left").alias("left_doc"), F.col("right").alias("right_doc"), F.coalesce("reason", F.lit("recovered")).alias("reason"))


# ---- relations and subgraphs

_REL = f"r AS (SELECT * FROM ({A.RELATIONS}) q WHERE status = 'success' AND relation IN ('support', 'conflict', 'none') QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY confidence DESC, seq) = 1)"


@query(f"WITH {_REL} SELECT pair_id, doc_a_id, doc_b_id, relation, confidence, seq FROM r")
def a9_relation_dedupe(spark, sf_dir):
    return relations.usable_relations(A.select(spark, sf_dir, A.RELATIONS))


@query(f"""WITH {_REL}, b AS (SELECT count(*) FILTER (WHERE status <> 'success') AS errors_skipped, count(*) FILTER (WHERE status = 'success' AND relation = 'odd') AS invalid_skipped,
    count(*) FILTER (WHERE status = 'success' AND relation = 'support') AS input_support, count(*) FILTER (WHERE status = 'success' AND relation = 'conflict') AS input_conflict, count(*) FILTER (WHERE status = 'success' AND relation = 'none') AS input_none FROM ({A.RELATIONS}) q)
    SELECT b.*, d.* FROM b, (SELECT count(*) FILTER (WHERE relation = 'support') AS deduplicated_support, count(*) FILTER (WHERE relation = 'conflict') AS deduplicated_conflict, count(*) FILTER (WHERE relation = 'none') AS deduplicated_none FROM r) d""")
def a9_relation_counts(spark, sf_dir):
    return relations.relation_counts(A.select(spark, sf_dir, A.RELATIONS))


_ENDS = "ends AS (SELECT unnest([doc_a_id, doc_b_id]) AS endpoint, pair_id AS edge, confidence AS trust, doc_a_id AS from_id, doc_b_id AS to_id FROM r WHERE relation = 'support'), n AS (SELECT endpoint, count(*) AS n FROM ends GROUP BY ALL), seed AS (SELECT r.*, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM r LEFT JOIN n a ON a.endpoint = doc_a_id LEFT JOIN n b ON b.endpoint = doc_b_id WHERE relation = 'conflict')"


@query(f"WITH {_REL}, {_ENDS} SELECT count(*) AS conflicts, count(*) FILTER (WHERE n_a > 0) AS left_supported, count(*) FILTER (WHERE n_b > 0) AS right_supported, count(*) FILTER (WHERE least(n_a, n_b) > 0) AS both_supported, count(*) FILTER (WHERE least(n_a, n_b) < 1) AS insufficient_support FROM seed")
def a10_support_coverage(spark, sf_dir):
    r = relations.usable_relations(A.select(spark, sf_dir, A.RELATIONS))
    return relations.coverage(r, r)


@query(f"""WITH {_REL}, {_ENDS}, picked AS (SELECT s.pair_id, s.doc_a_id, s.doc_b_id, side, edge, from_id, to_id, row_number() OVER (PARTITION BY s.pair_id, side ORDER BY trust DESC, edge) AS k FROM seed s JOIN (SELECT 0 AS side UNION ALL SELECT 1) d ON true JOIN ends ON endpoint = CASE WHEN side = 0 THEN doc_a_id ELSE doc_b_id END WHERE least(n_a, n_b) >= 1),
    nodes AS (SELECT DISTINCT pair_id, unnest([doc_a_id, doc_b_id, from_id, to_id]) AS node FROM picked WHERE k <= 2)
    SELECT concat('subgraph-', p.pair_id) AS subgraph_id, string_agg(edge, '|' ORDER BY side, k) AS support_edges, any_value(nn.nodes) AS node_ids FROM picked p JOIN (SELECT pair_id, string_agg(node, '|' ORDER BY node) AS nodes FROM nodes GROUP BY ALL) nn USING (pair_id) WHERE k <= 2 GROUP BY p.pair_id""")
def j9_subgraphs(spark, sf_dir):
    r = relations.usable_relations(A.select(spark, sf_dir, A.RELATIONS))
    return relations.subgraphs(r).select("subgraph_id", joined("support_edges").alias("support_edges"), joined("node_ids").alias("node_ids"))


@query(f"WITH {_REL}, {_ENDS} SELECT concat('subgraph-', pair_id) AS subgraph_id, confidence, least(n_a, n_b) AS least FROM seed WHERE least(n_a, n_b) >= 1 ORDER BY least(n_a, n_b) DESC, confidence DESC, pair_id LIMIT 25")
def w6_ranked_subgraphs(spark, sf_dir):
    r = relations.usable_relations(A.select(spark, sf_dir, A.RELATIONS))
    return relations.subgraphs(r, most=25).select("subgraph_id", "confidence", "least")


@query(f"""WITH {_REL}, p AS (SELECT pair_id, doc_a_id AS doc_a, CASE WHEN seq % 50 = 0 THEN 'x' || doc_b_id ELSE doc_b_id END AS doc_b FROM r)
    SELECT pair_id, doc_a, doc_b, md5(a.evidence) AS digest_a, coalesce(md5(b.evidence), '') AS digest_b, b.url AS url_b, CASE WHEN b.document_id IS NULL THEN 'document missing from the store' END AS error
    FROM p LEFT JOIN ({A.ORDER_EVIDENCE}) a ON a.document_id = doc_a LEFT JOIN ({A.ORDER_EVIDENCE}) b ON b.document_id = doc_b""")
def j8_relation_tasks(spark, sf_dir):
    """Some pairs name a document that the store lacks."""
    r = relations.usable_relations(A.select(spark, sf_dir, A.RELATIONS))
    r = r.select("pair_id", F.col("doc_a_id").alias("doc_a"), F.when(F.col("seq") % 50 == 0, F.concat(F.lit("x"), "doc_b_id")).otherwise(F.col("doc_b_id")).alias("doc_b"))
    docs = A.select(spark, sf_dir, A.ORDER_EVIDENCE).select(F.col("document_id").alias("doc_id"), "url", F.col("evidence").alias("text"))
    return relations.tasks(r, docs).select("pair_id", "doc_a", "doc_b", F.md5("text_a").alias("digest_a"), F.coalesce(F.md5("text_b"), F.lit("")).alias("digest_b"), "url_b", "error")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 3 = 1 OR o_orderkey % 5 = 1 THEN 'none' WHEN o_orderkey % 7 = 0 THEN 'support' ELSE 'conflict' END AS relation,
    CASE WHEN o_orderkey % 11 = 0 THEN 'invalid relation' WHEN o_orderkey % 13 = 0 THEN 'confidence must be in [0, 1]' ELSE '' END AS error FROM orders""")
def f32_p10_relation_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    flags = [(k % m != 1).alias(n) for m, n in ((2, "same_subject"), (3, "same_attribute"), (5, "same_fact_context"))]
    texts = [F.lit("x").alias(n) for n in ("subject", "attribute", "value_a", "value_b", "evidence_a", "evidence_b", "reason")]
    v = F.struct(F.when(k % 11 == 0, "odd").otherwise("support").alias("relation"), *flags, (k % 7 == 0).alias("values_compatible"), F.when(k % 13 == 0, 1.5).otherwise(0.5).alias("confidence"), *texts)
    o = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    return o.select("o_orderkey", relations.derived_relation("v").alias("relation"), F.coalesce(relations.relation_error("v"), F.lit("")).alias("error"))


# ---- scores


def _judged(spark, sf_dir):
    r = A.select(spark, sf_dir, A.JUDGED_EVENTS)
    return r.select("model", "benchmark_id", "status", evaluation.label_of("credit", F.lit(True)).alias("label"))


_LABEL = "CASE WHEN status <> 'success' THEN NULL WHEN credit IN ('complete', 'full', 'full_credit') THEN 'complete' WHEN credit IN ('partial', 'partial_credit') THEN 'partial' WHEN credit IN ('failed', 'failure', 'no_credit') THEN 'failed' END"
_FULL = f"WITH j AS (SELECT *, {_LABEL} AS label FROM ({A.JUDGED_EVENTS}) x), g AS (SELECT m.model, i.benchmark_id, j.status, coalesce(j.label, 'failed') AS label FROM (SELECT DISTINCT model FROM j) m CROSS JOIN ({A.ITEMS}) i LEFT JOIN j ON j.model = m.model AND j.benchmark_id = i.benchmark_id)"
_COUNTS = "count(*) AS n, count(*) FILTER (WHERE label = 'complete') AS complete, count(*) FILTER (WHERE label = 'partial') AS partial, count(*) FILTER (WHERE label = 'failed') AS failed"


@query(f"""{_FULL}, c AS (SELECT model, {_COUNTS}, count(status) AS result_records, count(*) FILTER (WHERE coalesce(status, '') <> 'success') AS missing_or_error, 0 AS ungraded FROM g GROUP BY model)
    SELECT *, complete / n AS c_rate, partial / n AS p_rate, failed / n AS f_rate, CASE WHEN complete + partial > 0 THEN complete / (complete + partial) ELSE 0.0 END AS k_rate FROM c""")
def a13_model_scores(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    out = evaluation.summarize(A.select(spark, sf_dir, A.ITEMS), judged, judged)
    return out.withColumn("ungraded", F.col("ungraded").cast("int"))


@query(f"{_FULL} SELECT {_COUNTS} FROM (SELECT benchmark_id, max_by(label, CASE label WHEN 'complete' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS label FROM g GROUP BY ALL) b")
def a12_best_of_models(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    rank = F.when(F.col("label") == "complete", 2).when(F.col("label") == "partial", 1).otherwise(0)
    best = judged.groupBy("benchmark_id").agg(F.max_by(F.struct("status", "label"), rank).alias("b")).select("benchmark_id", F.lit("success").alias("status"), "b.label")
    return evaluation.summarize(A.select(spark, sf_dir, A.ITEMS), best).select("n", "complete", "partial", "failed")


# the best label of each item under every set of models; the greedy step of each set; then the steps in turn
@query(f"""
    WITH RECURSIVE j AS (SELECT model, benchmark_id, CASE {_LABEL} WHEN 'complete' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS r FROM ({A.JUDGED_EVENTS}) x WHERE status = 'success'),
    mm AS (SELECT model, CAST(1 AS BIGINT) << (row_number() OVER (ORDER BY model) - 1) AS bit FROM (SELECT DISTINCT model FROM j) d), sets AS (SELECT unnest(range(0, CAST(pow(2, (SELECT count(*) FROM mm)) AS BIGINT))) AS mask),
    best AS (SELECT mask, i.benchmark_id, coalesce(max(j.r) FILTER (WHERE (mask & mm.bit) <> 0), 0) AS r FROM sets CROSS JOIN ({A.ITEMS}) i LEFT JOIN j ON j.benchmark_id = i.benchmark_id LEFT JOIN mm ON mm.model = j.model GROUP BY ALL),
    c AS (SELECT mask, count(*) AS n, count(*) FILTER (WHERE r = 2) AS complete, count(*) FILTER (WHERE r = 1) AS partial FROM best GROUP BY mask),
    step AS (SELECT s.mask, mm.model, mm.bit, n, complete, partial FROM sets s JOIN mm ON (s.mask & mm.bit) = 0 JOIN c ON c.mask = s.mask | mm.bit QUALIFY row_number() OVER (PARTITION BY s.mask ORDER BY complete DESC, mm.model) = 1),
    walk AS (SELECT 1 AS models, mask | bit AS mask, model, n, complete, partial FROM step WHERE mask = 0 UNION ALL SELECT models + 1, step.mask | step.bit, step.model, step.n, step.complete, step.partial FROM walk JOIN step ON step.mask = walk.mask)
    SELECT models, model AS added, n, complete / n AS c_rate, partial / n AS p_rate, (n - complete - partial) / n AS f_rate, CASE WHEN complete + partial > 0 THEN complete / (complete + partial) ELSE 0.0 END AS k_rate FROM walk""")
def w10_oracle_curve(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    return evaluation.oracle_curve(A.select(spark, sf_dir, A.ITEMS), judged.where("status = 'success'"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE NULL END AS label, CASE WHEN event_id % 4 = 3 THEN 'judge credit is inconsistent with coverage' END AS error FROM events""")
def f31_parse_judgment(spark, sf_dir):
    k = F.col("event_id") % 4
    golds = F.when(k == 0, '[{"covered": true, "evidence": ""}, {"covered": true, "evidence": ""}]').when(k == 2, '[{"covered": false, "evidence": ""}, {"covered": false, "evidence": ""}]').otherwise('[{"covered": true, "evidence": ""}, {"covered": false, "evidence": ""}]')
    credit = F.when(k == 0, "full_credit").when(k == 2, "no_credit").when(k == 1, "partial_credit").otherwise("full_credit")
    text = F.concat(F.lit('So:\n```json\n{"credit": "'), credit, F.lit('", "reasoning": "r", "gold_assessments": '), golds, F.lit(', "material_contradictions": []}\n```'))
    e = table(spark, sf_dir, "events").select("event_id", evaluation.parse_judgment(text, F.lit(2)).alias("j"))
    return e.select("event_id", "j.label", "j.error")


# ---- benchmark items


def _items(spark, sf_dir):
    k = F.col("o_orderkey")
    uuid = export.made_uuid(k.cast("string"))
    group = export.made_uuid(F.lit("g"), F.floor(k / 2).cast("string"))
    golds = F.when(k % 5 == 0, F.array(F.struct(F.lit("A ").alias("value")), F.struct(F.lit("a").alias("value")))).when(k % 7 == 0, F.array(F.struct(F.lit("a").alias("value")))).otherwise(F.array(F.struct(F.lit("a").alias("value")), F.struct(F.lit("b").alias("value"))))
    ev = F.struct(F.concat(F.lit("Who  is "), (k % 9000).cast("string")).alias("question"), golds.alias("gold_answers"), F.when(k % 11 == 0, " ").otherwise("a").alias("preferred_answer"))
    return table(spark, sf_dir, "orders").select(F.when(k % 13 == 0, "x").otherwise(uuid).alias("benchmark_id"), group.alias("item_group_id"), ev.alias("eval"), k.alias("line"))


@query("""SELECT o_orderkey AS line, array_to_string(list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'benchmark_id must be a canonical UUID string' END, CASE WHEN o_orderkey % 11 = 0 THEN 'eval.preferred_answer must be a non-empty string' END,
    CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 'eval.gold_answers must contain at least two items' END, CASE WHEN o_orderkey % 5 = 0 THEN 'eval.gold_answers must not contain duplicate values' END], lambda x: x IS NOT NULL), '|') AS errors FROM orders""")
def p9_item_errors(spark, sf_dir):
    return _items(spark, sf_dir).select("line", joined(evaluation.item_errors()).alias("errors"))


@query("""WITH i AS (SELECT o_orderkey AS line, o_orderkey % 9000 AS q, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_orderkey AS STRING) END AS id, CAST(floor(o_orderkey / 2) AS BIGINT) AS g FROM orders)
    SELECT (SELECT count(*) FROM i) AS records, (SELECT count(DISTINCT id) FROM i) AS unique_ids, (SELECT count(DISTINCT q) FROM i) AS unique_questions, (SELECT count(DISTINCT g) FROM i) AS item_groups, (SELECT count(*) FROM (SELECT g FROM i GROUP BY g HAVING count(*) < 2) s) AS singleton_groups""")
def a14_dataset_report(spark, sf_dir):
    return evaluation.dataset_report(_items(spark, sf_dir)).select("records", "unique_ids", "unique_questions", "item_groups", "singleton_groups")


@query("""WITH i AS (SELECT o_orderkey AS line, concat('who is ', CAST(o_orderkey % 9000 AS STRING)) AS q, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_orderkey AS STRING) END AS id, CAST(floor(o_orderkey / 2) AS BIGINT) AS g FROM orders),
    own AS (SELECT o_orderkey AS line, unnest(list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'benchmark_id must be a canonical UUID string' END, CASE WHEN o_orderkey % 11 = 0 THEN 'eval.preferred_answer must be a non-empty string' END,
        CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 'eval.gold_answers must contain at least two items' END, CASE WHEN o_orderkey % 5 = 0 THEN 'eval.gold_answers must not contain duplicate values' END], lambda x: x IS NOT NULL)) AS error FROM orders)
    SELECT coalesce(CAST(line AS STRING), '') AS line, error FROM (SELECT line, error FROM own UNION ALL SELECT line, 'duplicate benchmark_id x' FROM (SELECT line, row_number() OVER (PARTITION BY id ORDER BY line) AS k FROM i WHERE id = 'x') d WHERE k > 1
    UNION ALL SELECT line, 'duplicate normalized question (first seen on line ' || first || ')' FROM (SELECT line, min(line) OVER (PARTITION BY q) AS first FROM i) d WHERE line > first
    UNION ALL SELECT NULL, 'groups of one: ' || count(*) FROM (SELECT g FROM i GROUP BY g HAVING count(*) < 2) s) a""")
def a14_dataset_errors(spark, sf_dir):
    """All errors by line; those of groups, whose made ids SQL lacks, as a count."""
    errors = evaluation.dataset_errors(_items(spark, sf_dir))
    groups = errors.where("line is null").agg(F.lit(None).cast("long").alias("line"), F.concat(F.lit("groups of one: "), F.count("*").cast("string")).alias("error"))
    return errors.where("line is not null").unionByName(groups).select(F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"), "error")


def _stages(spark, sf_dir):
    """Synthesis, source validation and verification rows of orders as subgraphs, with retries."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt")).where("attempt = 0 or o_orderkey % 4 = 0")
    base = o.select(F.concat(F.lit("s"), k.cast("string")).alias("subgraph_id"), "attempt", F.when((k % 4 == 0) & (F.col("attempt") == 0), "error").otherwise("success").alias("status"), k.alias("k"), (k * 2 + F.col("attempt")).alias("seq"))
    ask = lambda form: F.struct(F.lit(form).alias("formulation"), F.concat(F.lit(f"{form} "), F.col("k").cast("string")).alias("question"))
    qa = F.struct(F.lit(True).alias("keep"), F.array(*map(ask, C.FORMULATIONS)).alias("questions"), F.array(F.struct(F.lit("a").alias("value")), F.struct(F.lit("b").alias("value"))).alias("gold_answers"), F.lit("a").alias("preferred_answer"))
    keep = lambda m: F.struct((F.col("k") % m != 0).alias("keep"), F.when(F.col("k") % m != 0, "verified").otherwise("rejected").alias("verdict"))
    last = F.when((F.col("k") % 9 == 0), "error").otherwise(F.col("status"))
    return base.select("subgraph_id", "status", "seq", qa.alias("qa")), base.select("subgraph_id", "status", "seq", keep(5).alias("validation")), base.select("subgraph_id", last.alias("status"), "seq", keep(3).alias("verification"))


_EXPORT = "CASE WHEN o_orderkey % 9 = 0 THEN 'verification_error' WHEN o_orderkey % 3 = 0 THEN 'verification_rejected' WHEN o_orderkey % 5 = 0 THEN 'source_validation_rejected' ELSE 'exported' END"


@query(f"SELECT {_EXPORT} AS reason, count(*) AS subgraphs FROM orders GROUP BY ALL")
def j12_export_decisions(spark, sf_dir):
    return export.decisions(*_stages(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("exported")).alias("reason")).agg(F.count("*").alias("subgraphs"))


@query(f"SELECT concat(f, ' ', CAST(o_orderkey AS STRING)) AS question, 'a|b' AS golds, true AS canonical FROM orders CROSS JOIN (SELECT unnest(['named_entity', 'clue_based']) AS f) x WHERE {_EXPORT} = 'exported'")
def x8_export_records(spark, sf_dir):
    r = export.export_records(*_stages(spark, sf_dir))
    return r.select("eval.question", joined("eval.gold_answers.value").alias("golds"), (T.is_canonical_uuid("benchmark_id") & T.is_canonical_uuid("item_group_id")).alias("canonical"))


@query("SELECT concat('s', CAST(o_orderkey AS STRING)) AS subgraph_id FROM orders WHERE o_orderkey % 5 <> 0")
def s19_p8_latest_kept(spark, sf_dir):
    return lookups.latest_kept(_stages(spark, sf_dir)[1], "validation").select("subgraph_id")


@query("SELECT o_orderkey AS seq FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500) x WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 1")
def w8_j15_resume(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"))
    done = o.where("seq % 3 = 0").select("seq", F.when(F.col("seq") % 2 == 1, "error").otherwise("success").alias("status"))
    return lookups.todo(o, done, "seq", limit=500)


# ---- entities and checks of model outputs


def _word_mentions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("start", "text"))
    return words.select("doc_id", "text", F.lower("text").alias("norm"), F.when(F.length("text") % 2 == 0, "person").otherwise("location").alias("label"), "start")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{3,}'), 1) - 1 AS s FROM documents),
    f AS (SELECT doc_id, CASE WHEN length(t) % 2 = 0 THEN 'person' ELSE 'location' END AS label, lower(t) AS norm, count(*) AS count, min(s) AS first_start, min(t) AS text FROM w GROUP BY ALL)
    SELECT doc_id, text, norm, label, count, CAST(first_start AS INT) AS first_start FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first_start, norm, label) <= 64""")
def a7_mention_aggregation(spark, sf_dir):
    return mentions.aggregate_mentions(_word_mentions(spark, sf_dir), ["doc_id"]).drop("surface_forms")


_EDGE = "[\\s\\x0b!-/:-@\\[-`{-~“”‘’·•…—–]"
_BARE = "regexp_replace({0}, '^" + _EDGE.replace("{", "{{") + "+|" + _EDGE.replace("{", "{{") + "+$', '', 'g')"
_ALIASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ENTITY_ALIASES.items())
# entity names of texts whose letters are composed already, as the tables' are
_NAME = f"""SELECT *, CASE v3 {_ALIASES} ELSE v3 END AS norm FROM (
    SELECT *, {_BARE.format("regexp_replace(regexp_replace(v2, '\\s+([,.;:/)])', '\\1', 'g'), '([(])\\s+', '\\1', 'g')")} AS v3 FROM (
    SELECT *, replace(lower({_BARE.format("regexp_replace(v1, '(?i)' || chr(39) || 's([^\\p{L}\\p{N}_]|$)', '\\1', 'g')")}), 'ß', 'ss') AS v2 FROM (
    SELECT *, {_BARE.format("regexp_replace(regexp_replace(replace(surface, '’', chr(39)), 'https?://\\S+|\\b[A-Za-z]+://', ' ', 'g'), '\\s+', ' ', 'g')")} AS v1 FROM (@ROWS@) n0) n1) n2) n3"""
_REASONABLE = f"""length(norm) BETWEEN 2 AND 120 AND norm NOT IN ({quoted(C.NAVIGATION_WORDS)}) AND NOT regexp_full_match(norm, '[0-9]+') AND len(regexp_extract_all(norm, '\\S+')) <= 12
    AND NOT (length(norm) = 2 AND norm NOT IN ({quoted(C.TWO_LETTER_NAMES)}) AND NOT regexp_full_match(regexp_replace(surface, '[^A-Za-z]', '', 'g'), '[A-Z][A-Z]'))
    AND length(regexp_replace(norm, '[^\\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(norm, '[^\\p{{L}}]', '', 'g')) / length(norm) >= 0.35 AND NOT contains(surface, chr(10))
    AND NOT (regexp_matches(regexp_extract(surface, '\\p{{L}}'), '\\p{{Ll}}') AND NOT (length(regexp_extract(surface, '\\S+')) > 3 AND regexp_matches(surface, '\\p{{Lu}}')))"""


@query(f"""
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL),
    t AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e, regexp_matches(word, '^[A-Z]') AS b FROM w),
    l AS (SELECT *, e - length(word) AS s FROM t WHERE word <> '' AND (b OR regexp_matches(word, '[,.]\\n?$'))),
    g AS (SELECT *, CASE WHEN lag(e) OVER o IS NULL OR (b AND s > lag(e) OVER o + 1) OR s > lag(e) OVER o + 2 THEN 1 ELSE 0 END AS new FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT doc_id, span, CAST(min(s) AS INT) AS s, CAST(max(e) AS INT) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g) x GROUP BY ALL),
    n AS ({_NAME.replace("@ROWS@", "SELECT r.doc_id, s, e, " + _BARE.format("substring(text, s + 1, e - s)") + " AS surface FROM r JOIN documents USING (doc_id)")})
    SELECT doc_id, surface AS text, norm, 'person' AS label, s AS start, e AS end FROM n WHERE {_REASONABLE}""")
def f29_decode_mentions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    label = F.when(F.col("word").rlike("^[A-Z]"), "B-PER").when(F.col("word").rlike("[,.]$"), "I-PER").otherwise("O")
    t = mentions.word_tokens(d, "doc_id").select("doc_id", F.lit(0).alias("chunk_start"), "start", "end", label.alias("label"))
    # an O word with its two blanks is three characters at least, so spans end there without it too
    return mentions.decode_mentions(t.where("label <> 'O'"), ["doc_id"], texts=d)


# windows of a document one after the other, over the places of its tokens
@query("""
    WITH RECURSIVE p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]|\\s+')) AS x, generate_subscripts(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]|\\s+'), 1) AS i FROM documents),
    t AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p), d AS (SELECT doc_id, list(e - length(x) ORDER BY i) AS s, list(e ORDER BY i) AS e, count(*) AS n FROM t WHERE NOT regexp_matches(x, '^\\s') GROUP BY doc_id),
    r AS (SELECT doc_id, CAST(0 AS BIGINT) AS k FROM d UNION ALL
        SELECT doc_id, CASE WHEN coalesce(pos, 0) > 0 THEN k + pos ELSE stop END FROM (
            SELECT doc_id, k, stop, list_position(list_transform(s[k + 2:stop], lambda x: x >= greatest(s[k + 1] + 1, e[stop] - 100)), true) AS pos FROM (SELECT d.*, k, least(n, k + 510) AS stop FROM r JOIN d USING (doc_id)) q WHERE stop < n) z)
    SELECT CAST(doc_id AS STRING) AS document_id, CAST(s[k + 1] AS BIGINT) AS chunk_start, md5(substring(text, CAST(s[k + 1] AS BIGINT) + 1, CAST(e[least(n, k + 510)] - s[k + 1] AS BIGINT))) AS digest FROM r JOIN d USING (doc_id) JOIN documents USING (doc_id)""")
def f28_token_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return mentions.chunk_documents(d).select("document_id", "chunk_start", F.md5("chunk_text").alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'gold answer 0 evidence is not verbatim' WHEN o_orderkey % 5 = 0 THEN 'question leaks a gold answer' WHEN o_orderkey % 7 = 0 THEN 'gold answer values must be distinct' ELSE '' END AS errors FROM orders""")
def p12_qa_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    answer = lambda v, quote: F.struct(v.alias("value"), F.array(F.lit("d1")).alias("supporting_doc_ids"), F.array(F.struct(F.lit("d1").alias("doc_id"), quote.alias("quote"))).alias("evidence_spans"))
    golds = F.array(answer(F.lit("twelve"), F.when(k % 3 == 0, "13 votes").otherwise("12  VOTES")), answer(F.when((k % 7 == 0) & (k % 3 != 0) & (k % 5 != 0), "Twelve").otherwise("thirty"), F.lit("votes")))
    ask = lambda f: F.struct(F.lit(f).alias("formulation"), F.when((k % 5 == 0) & (k % 3 != 0) & F.lit(f == "clue_based"), "were it Thirty").otherwise("how many").alias("question"))
    qa = F.struct(F.lit(True).alias("keep"), F.lit(None).cast("string").alias("rejection_reason"), F.lit("s").alias("subject"), F.lit("a").alias("attribute"), F.lit("twelve").alias("preferred_answer"), F.array(*map(ask, C.FORMULATIONS)).alias("questions"), golds.alias("gold_answers"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", qa.alias("qa"), F.array(F.struct(F.lit("d1").alias("doc_id"), F.lit("It got 12 votes.").alias("text"))).alias("documents"))
    return o.select("o_orderkey", joined(validators.qa_errors()).alias("errors"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'answer verification 1 evidence is not verbatim' WHEN o_orderkey % 5 = 0 THEN 'answer verification 1 cites an unknown document'
    WHEN o_orderkey % 7 = 0 THEN 'keep=true requires every comparability and QA check to pass' WHEN o_orderkey % 11 = 0 THEN 'keep=true requires verdict=verified' ELSE '' END AS errors FROM orders""")
def p13_source_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    quote = F.when(k % 3 == 0, "13 votes").otherwise("12 votes")
    span = lambda d, q: F.array(F.struct(d.alias("doc_id"), q.alias("quote")))
    where = F.when((k % 5 == 0) & (k % 3 != 0), "d9").otherwise("d1")
    check = lambda v, d, q: F.struct(F.lit(v).alias("value"), F.lit(True).alias("supported"), span(d, q).alias("evidence_spans"), F.lit("r").alias("reason"))
    others = (k % 3 == 0) | (k % 5 == 0)
    flags = [F.lit(True).alias(n) for n in ("same_subject", "same_attribute", "same_fact_context")]
    v = F.struct(F.lit(True).alias("keep"), F.when(~others & (k % 7 != 0) & (k % 11 == 0), "rejected").otherwise("verified").alias("verdict"), *flags, (others | (k % 7 != 0)).alias("qa_valid"), F.lit("r").alias("reason"),
                 F.array(check("12", F.lit("d1"), F.lit("got 12")), check("30", where, quote)).alias("answer_verifications"))
    qa = F.struct(F.array(F.struct(F.lit("12").alias("value")), F.struct(F.lit("30").alias("value"))).alias("gold_answers"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("validation"), qa.alias("qa"), F.array(F.struct(F.lit("d1").alias("doc_id"), F.lit("It got 12 votes.").alias("text"))).alias("documents"))
    return o.select("o_orderkey", joined(validators.source_errors()).alias("errors"))


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS rounds, count(*) AS tasks FROM orders GROUP BY ALL""")
def x6_model_stage(spark, sf_dir):
    """Tasks answered from a table; every third first answer is rejected, every fourth task has none that parses."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    tasks = o.select(k.cast("string").alias("key"), F.concat(F.lit("order "), k.cast("string")).alias("prompt"))
    answers = o.select(k.cast("string").alias("key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), k.alias("k"))
    good = F.concat(F.lit('{"v": '), F.when((F.col("k") % 3 == 0) & (F.col("attempt") == 1), -1).otherwise(1).cast("string"), F.lit("}"))
    answers = answers.select("key", "attempt", F.when(F.col("k") % 4 == 0, "no object").otherwise(good).alias("response"))
    done = responders.run_stage(tasks, responders.replay(answers), lambda c: F.from_json(evaluation.json_object(c), "v int"), lambda df: F.array_compact(F.array(F.when(F.col("value.v") < 0, "negative"))))
    return done.groupBy("status", "rounds").agg(F.count("*").alias("tasks"))


from contrasto.plans import records, stages  # noqa: E402, F401  (register theirs)
