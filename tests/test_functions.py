import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions import entities as E
from contrasto.functions import text as T
from contrasto.operators import evaluation, mentions, web


def one(spark, col, **values):
    kinds = {k: v for k, v in values.items()}
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in kinds.items()]) if kinds else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_spaces_and_hashes(spark):
    assert one(spark, T.normalize_space("s"), s=" a   b\n") == "a b"
    assert one(spark, T.normalize_space("s"), s=None) == ""
    assert one(spark, T.stable_hash("s"), s="x") == hashlib.sha1(b"x").hexdigest()[:16]
    assert one(spark, T.unit_interval("s"), s="x") == int(hashlib.sha1(b"x").hexdigest()[:16], 16) / 2**64
    assert one(spark, T.pair_id("a", "b"), a="z", b="y") == "pair-" + hashlib.sha1(b"y\0z").hexdigest()[:20]


def test_urls(spark):
    assert one(spark, T.source_domain("u"), u="https://me@WWW.A_b.example.com.:80/x") == "a_b.example.com"
    assert one(spark, T.source_domain("u"), u="no host") == ""
    assert one(spark, T.canonical_url("u"), u="HTTP://Ex.com:80/a/?q=1#f") == "//ex.com/a?q=1"
    assert one(spark, T.canonical_url("u"), u="https://ex.com:8443") == "//ex.com:8443/"


def test_signals(spark):
    assert one(spark, T.extract_slots("s"), s="He died aged 7, no.1 by votes") == ["age", "death", "rank", "votes"]
    assert one(spark, T.extract_dates("s"), s="On 2001-02-03, Mar 4, 1999 and 5  May 2010; 2001-02-03") == ["2001-02-03", "mar 4, 1999", "5 may 2010"]
    assert one(spark, T.extract_numbers("s"), s="$1,200.50 or -3% of 12 Million; v2.5 12 million") == ["$1200.50", "-3%", "12 million"]
    assert one(spark, T.content_tokens("s"), s="bb-b aaa the The which aaa xx") == ["aaa", "the", "bb-b"]
    assert one(spark, T.content_tokens("s"), s=None) == []


def test_scores(spark):
    side = "named_struct('tokens', array('a','b'), 'dates', array({d}), 'numbers', array({n}), 'source_domain', '{s}', 'confidence', {c})"
    df = spark.sql("select " + side.format(d="'2001'", n="'1'", s="x", c="0.81D") + " l, " + side.format(d="'2002'", n="'1'", s="y", c="1.0D") + " r")
    s = df.select(T.pair_scores(F.col("l"), F.col("r")).alias("s")).first()["s"]
    assert s["date_mismatch"] and not s["number_mismatch"]
    assert s["support_score"] == 6 + 0.9 + 0.5 and s["conflict_score"] == 6 + 0.9 + 0.5 + 2
    assert math.isclose(one(spark, T.jaccard("a", "b"), a=["x", "y"], b=["y", "z"]), 1 / 3)


def test_primary_tag(spark):
    tag = "named_struct('confidence', {c}D, 'discipline', '{d}', 'field', 'f', 'subfield', '{s}')"
    df = spark.sql(f"select array({tag.format(c=0.9, d='B', s='x')}, {tag.format(c=0.9, d='a', s='y')}, {tag.format(c=1.0, d='a', s='')}) t")
    assert df.select(T.select_primary_tag("t").alias("x")).first()["x"]["subfield"] == "y"


def test_entities():
    assert E.entity_name("U.S.") == "united states" and E.entity_name("“Anna’s”") == "anna"
    assert E.plausible_entity("Anna Lee", "anna lee") and not E.plausible_entity("click", "click")
    assert not E.plausible_entity("12:30", "12:30") and E.plausible_entity("EU", "eu") and not E.plausible_entity("of Paris", "of paris")
    rows = [{"text": "Example Person", "surface_forms": None, "label": "person", "count": 0, "first_start": 0}, {"text": "the Example", "surface_forms": ["Example"], "label": "misc", "count": 3, "first_start": 5}]
    got = E.choose_subjects("Example Person won", rows, 2)
    assert [g["norm"] for g in got] == ["example person", "example"] and got[0]["mention_count"] == 1 and got[0]["first_start"] is None


def test_aliases(spark):
    df = spark.sql("select named_struct('text','Anna Miller','norm','anna miller','label','person','mention_count',1,'first_start',3) s")
    got = df.select(E.subject_variants("s", True).alias("x")).first()["x"]
    assert [(g["norm"], g["alias_scope"]) for g in got] == [("anna miller", "all"), ("miller", "kp")]
    df = spark.sql("select named_struct('text','World Trade Body','norm','world trade body','label','organization','mention_count',1,'first_start',3) s")
    got = df.select(E.subject_variants("s", True).alias("x")).first()["x"]
    assert got[1]["text"] == "WTB" and got[1]["alias_kind"] == "organization_acronym"


def test_sentences(spark):
    got = one(spark, mentions.sentences("s", 5), s="One. Two!\r\nabcdefgh 中。文")
    assert [(x["n"], x["sentence"]) for x in got] == [(1, "One."), (2, "Two!"), (3, "abcde"), (4, "fgh 中"), (5, "。"), (6, "文")]
    assert one(spark, mentions.visible_text(mentions.sentences("s", 0)), s="A. B.") == "S000001: A.\nS000002: B."


def test_token_chunks():
    random.seed(1)
    text = " ".join("w" * random.randrange(1, 9) for _ in range(300))
    got = mentions.token_chunks(text, 20, 30)
    assert all(text[a : a + len(t)] == t and len(t.split()) <= 20 for a, t in got)
    covered = set()
    for a, t in got:
        covered.update(range(a, a + len(t)))
    assert all(k in covered for k, c in enumerate(text) if c != " ")


def test_mentions(spark):
    text = "Anna Lee met Bob"
    rows = [(text, 0, 4, "B-PER"), (text, 5, 8, "I-PER"), (text, 9, 12, "O"), (text, 13, 16, "B-PER")]
    t = spark.createDataFrame([(1, 100, *r) for r in rows], "id long, chunk_start long, text string, start long, end long, label string")
    m = mentions.decode_mentions(t, ["id"])
    assert sorted((r["text"], r["start"], r["end"]) for r in m.collect()) == [("Anna Lee", 100, 108), ("Bob", 113, 116)]
    again = m.unionByName(m.where("text = 'Bob'"))
    top = mentions.aggregate_mentions(again, ["id"]).orderBy(F.desc("count")).first()
    assert top["norm"] == "bob" and top["count"] == 2 and top["surface_forms"] == ["Bob"]


def test_tag_checks(spark):
    df = spark.sql("select 'One. Two. Three. Four.' t, named_struct('is_knowledge_bearing', true, 'content_type', 'x', 'language', 'en', 'reason', '', 'tag_paths', array(named_struct('path', 'A -> B -> C', 'confidence', 0.5D, 'evidence_start_sentence', 3, 'evidence_end_sentence', 2))) v")
    s = mentions.sentences("t", 0)
    assert df.select(mentions.tag_errors("v", s, F.array(F.lit("A -> B -> C"))).alias("e")).first()["e"] == []
    assert df.select(mentions.tag_errors("v", s, F.array(F.lit("D"))).alias("e")).first()["e"] == ["tag_paths[0] has an invalid taxonomy path"]
    tag = df.select(mentions.normalized_tags("v", s).alias("e")).first()["e"][0]
    assert tag["evidence"] == "Two. Three." and tag["subfield"] == "C"


def test_web(spark):
    p = one(spark, web.page_text("h"), h="<title>A  B</title><p>x &amp; y</p><script>z</script><div>q</div>")
    assert p["title"] == "A B" and p["text"] == "A B x & y\nq"
    payload = '{"web": {"results": [{"url": "ftp://x"}, {"url": "http://a/", "title": "T &lt;"}, {"url": "http://a/"}, {"url": "https://b/", "description": " d  e"}]}}'
    odd = ['{"web": {"results": ["text", 3, null, {"title": "no address"}, {"url": "https:///x"}, {"url": "http://user@host:80/a"}]}}', '{"web": []}', "no JSON", "[]", None]
    payloads = spark.createDataFrame([(0, payload), *enumerate(odd, 1)], "q int, payload string")
    got = sorted((r["q"], r["rank"], r["url"], r["title"], r["snippet"]) for r in web.search_results(payloads, ["q"]).collect())
    assert got == [(0, 1, "http://a/", "T <", ""), (0, 2, "https://b/", "", "d e"), (1, 1, "http://user@host:80/a", "", "")]
    many = spark.createDataFrame([(0, json.dumps({"web": {"results": [{"url": f"https://h/{k // 2}"} for k in range(30)]}}))], "q int, payload string")
    assert [(r["rank"], r["url"]) for r in web.search_results(many, ["q"], limit=3).orderBy("rank").collect()] == [(k + 1, f"https://h/{k}") for k in range(3)]
    hidden = web.read_page("<svg><p>no</svg></svg>yes<template>a<style>b</style>c</template> &copy; 1<br/>two<h2>three</h2><title>x<script>y</script>z")
    assert hidden == {"title": "x z", "text": "yes © 1\ntwo three\nx z"}
    fake = lambda ip: lambda h, p: [(0, 0, 0, "", (ip, p))]
    assert web.is_public_url("https://a.example", fake("8.8.8.8")) and not web.is_public_url("http://a.example", fake("10.0.0.1")) and not web.is_public_url("file:///x", fake("8.8.8.8"))


def test_judgments_are_parsed_once(spark):
    """However many checks read a judgment, its text is searched and parsed once."""
    said = str(evaluation.parse_judgment("raw", F.lit(2)))
    assert said.count("from_json") == 1 and said.count("trim(raw)") == 1


def test_slots_as_by_pattern_alone(spark):
    """Words within words, other cases, folding beyond ASCII: as the patterns say."""
    words = ["aged", "AGE", "page", "years old", "no.", "no", "ſize", "sİze", "ſtaff", "Kılled", "Killed", "work's cost", "cost-of", "élection", "elections", "prısON", "due  to", "due to", "size_", "ranked."]
    rng = random.Random(6)
    texts = [*words, None, "", *[" ".join(rng.choices(words, k=4)) for _ in range(60)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    alone = [F.when(F.coalesce("t", F.lit("")).rlike(rf"(?iU)\b(?:{w})\b"), F.lit(n)) for n, w in C.SLOT_WORDS.items()]
    rows = df.select("t", T.extract_slots("t").alias("got"), F.array_compact(F.array(*alone)).alias("want")).collect()
    assert all(list(r["got"]) == list(r["want"]) for r in rows) and sum(map(lambda r: len(r["want"]), rows)) > 50


def test_slots_take_less_than_patterns(spark):
    """Patterns are tried where a word of theirs lies: fast on texts without any."""
    import time

    df = spark.range(20_000).select(F.concat(F.lit("Nothing here names what the patterns look for, in sentence " * 3), F.col("id").cast("string")).alias("t")).repartition(1).cache()
    df.count()

    def seconds(c):
        start = time.perf_counter()
        df.select(c.alias("x")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    alone = F.array_compact(F.array(*[F.when(F.col("t").rlike(rf"(?iU)\b(?:{w})\b"), F.lit(n)) for n, w in C.SLOT_WORDS.items()]))
    assert min(seconds(T.extract_slots("t")) for _ in range(3)) < min(seconds(alone) for _ in range(3))
