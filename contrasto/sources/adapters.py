"""Inputs of the operators made from the star-schema tables, in SQL that Spark and DuckDB both run.

Each adapter is a SELECT; ``{table}`` names are views.  Numbers in texts come from integer arithmetic, so both
engines write them alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_DAY = "concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_UNITS = f"CAST(CAST(floor({_CENTS} / 100) AS BIGINT) AS STRING)"

#: Orders as documents with one sentence of evidence, their topic and domain.
ORDER_EVIDENCE = f"""
    SELECT concat('o', CAST(o_orderkey AS STRING)) AS document_id, o_orderkey AS seq, r_name AS discipline, n_name AS field, o_orderpriority AS subfield, c_name AS customer,
           CAST(85 + o_orderkey % 15 AS DOUBLE) / 100 AS confidence, CASE WHEN o_orderkey % 17 = 0 THEN 'de' WHEN o_orderkey % 13 = 0 THEN '' ELSE 'en' END AS language,
           CASE WHEN o_orderkey % 11 = 0 THEN concat('The order of ', c_name)
                ELSE concat('The order of ', c_name, ' in ', n_name, ' dated ', {_DAY}, ' was priced at ', {_UNITS}, ' dollars and ranked ', o_orderpriority, ' with its priority') END AS evidence,
           concat('https://www.src', CAST(o_orderkey % 7 AS STRING), '.example/', CAST(o_orderkey AS STRING)) AS url
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

#: The same orders as flat anchors with features.
ORDER_ANCHORS = f"""
    SELECT concat('o', CAST(o_orderkey AS STRING)) AS doc_id, concat(r_name, '/', n_name) AS kp_key, lower(c_name) AS subject, slot, CAST(85 + o_orderkey % 15 AS DOUBLE) / 100 AS confidence,
           split(concat(CAST(year(o_orderdate) AS STRING), ''), ',') AS dates, split(concat(CAST({_CENTS} % 5 AS STRING), ',', CAST({_CENTS} % 3 AS STRING)), ',') AS numbers,
           split(concat(lower(n_name), ',', o_orderpriority, ',', o_orderstatus, ',m', CAST(month(o_orderdate) AS STRING), ',c', CAST(o_custkey % 50 AS STRING), ',k', CAST(o_orderkey % 9 AS STRING)), ',') AS tokens,
           concat('src', CAST(o_orderkey % 7 AS STRING)) AS source_domain, CASE WHEN o_orderkey % 19 = 0 THEN 'kp' ELSE 'all' END AS alias_scope,
           o_orderkey * 2 + CASE WHEN slot = 'price' THEN 0 ELSE 1 END AS seq
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    CROSS JOIN (SELECT 'price' AS slot UNION ALL SELECT 'date' AS slot) s"""

#: As above, with a topic per priority, so that a customer's orders lie in several.
SPLIT_ANCHORS = ORDER_ANCHORS.replace("concat(r_name, '/', n_name) AS kp_key", "concat(r_name, '/', o_orderpriority) AS kp_key")

#: Judged results of five models over 200 items: the latest event of each model and item; model m4 lacks some items.
JUDGED_EVENTS = """
    SELECT concat('m', CAST(model AS STRING)) AS model, concat('i', CAST(item AS STRING)) AS benchmark_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
           CASE event_type WHEN 'purchase' THEN 'full_credit' WHEN 'click' THEN 'partial' WHEN 'view' THEN 'partial_credit' WHEN 'signup' THEN 'failed' ELSE 'unknown' END AS credit
    FROM (SELECT user_id % 5 AS model, event_id % 200 AS item, event_type, row_number() OVER (PARTITION BY user_id % 5, event_id % 200 ORDER BY event_id DESC) AS k FROM events) e
    WHERE k = 1 AND NOT (model = 4 AND item % 7 = 0)"""

ITEMS = "SELECT DISTINCT concat('i', CAST(event_id % 200 AS STRING)) AS benchmark_id FROM events"

#: Known pairs: consecutive orders of a customer, some of them reversed.
KNOWN_PAIRS = """
    SELECT least(a, b) AS left_doc, greatest(a, b) AS right_doc FROM (
        SELECT concat('o', CAST(o_orderkey AS STRING)) AS a, concat('o', CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS STRING)) AS b, o_orderkey AS k FROM orders) p
    WHERE b IS NOT NULL AND b <> 'o' AND k % 3 = 0"""

#: Known pairs and others: orders that follow one another whoever placed them, and pairs with a document that is nowhere.
AUDIT_PAIRS = f"""
    SELECT left_doc, right_doc FROM ({KNOWN_PAIRS}) k
    UNION ALL SELECT least(a, b) AS left_doc, greatest(a, b) AS right_doc FROM (SELECT concat('o', CAST(o_orderkey AS STRING)) AS a, concat('o', CAST(lead(o_orderkey) OVER (ORDER BY o_orderkey) AS STRING)) AS b FROM orders) n WHERE b IS NOT NULL AND b <> 'o'
    UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)) AS left_doc, concat('x', CAST(o_orderkey AS STRING)) AS right_doc FROM orders WHERE o_orderkey % 31 = 0"""

#: Relations between a customer's consecutive orders, some judged twice.
RELATIONS = """
    SELECT concat('pair-', doc_a_id, '-', doc_b_id) AS pair_id, doc_a_id, doc_b_id, CASE WHEN k % 23 = 0 THEN 'error' ELSE 'success' END AS status,
           CASE WHEN k % 29 = 0 THEN 'odd' WHEN k % 3 = 0 THEN 'conflict' WHEN k % 5 = 0 THEN 'none' ELSE 'support' END AS relation, CAST((k * 7 + copy * 13) % 100 AS DOUBLE) / 100 AS confidence, k * 2 + copy AS seq
    FROM (SELECT concat('o', CAST(o_orderkey AS STRING)) AS doc_a_id, concat('o', CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS STRING)) AS doc_b_id, o_orderkey AS k FROM orders) p
    CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) c
    WHERE doc_b_id IS NOT NULL AND doc_b_id <> 'o' AND (copy = 0 OR k % 4 = 0)"""

#: Documents as raw records, with a url of their source.
RAW_DOCUMENTS = """
    SELECT concat('https://', source, '.example/', CAST(doc_id AS STRING)) AS url, text, lang AS language, doc_id AS seq, CASE WHEN doc_id % 10 = 0 THEN concat('d', CAST(doc_id - doc_id % 20 AS STRING)) ELSE '' END AS given_id FROM documents"""


def views(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> None:
    """The tables as temporary views.  A table of fewer splits than the session has cores is dealt over them: one of the test data is one file and so one task."""
    cores = spark.sparkContext.defaultParallelism
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t not in ("region", "nation") and df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
        df.createOrReplaceTempView(t)


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The adapter's rows, made from the tables that it names.

    Tables are dealt before the adapter's joins and texts and not after them, so that narrow rows are shuffled, and large tables aren't.
    """
    views(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", sql)])
    return spark.sql(sql)
