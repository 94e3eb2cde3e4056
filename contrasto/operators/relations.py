"""Relations between documents of a pair: tasks, validation of judgments, deduplication, conflict subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions import text as T

FLAGS = ("same_subject", "same_attribute", "same_fact_context", "values_compatible")
JUDGMENT = "relation string, same_subject boolean, same_attribute boolean, same_fact_context boolean, values_compatible boolean, subject string, attribute string, value_a string, value_b string, evidence_a string, evidence_b string, confidence double, reason string"


def tasks(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs with the texts of both documents; ``error`` where one is missing.  docs: doc_id, url, text."""
    side = lambda s: docs.select(F.col("doc_id").alias(f"doc_{s}"), F.col("url").alias(f"url_{s}"), F.col("text").alias(f"text_{s}"))
    out = candidates.join(side("a"), "doc_a", "left").join(side("b"), "doc_b", "left")
    return out.withColumn("error", F.when(F.col("text_a").isNull() | F.col("text_b").isNull(), "document missing from the store"))


def compact(candidates: DataFrame, feats: DataFrame) -> DataFrame:
    """Candidate pairs as tasks: pair_id, doc_a, doc_b and ``metadata`` as JSON with the hints of retrieval.  feats: doc_id, f."""
    side = lambda s: feats.select(F.col("doc_id").alias(f"doc_{s}"), F.col("f").alias(f"f_{s}"))
    both = candidates.join(side("a"), "doc_a").join(side("b"), "doc_b")
    hints = F.struct("retrieval_signals", "subjects", "slots", *[F.col(f"f_{s}.{k}").alias(f"{n}_{s}") for s in "ab" for k, n in (("kp_key", "knowledge_point"), ("dates", "dates"), ("numbers", "numbers"))])
    return both.select("pair_id", "doc_a", "doc_b", F.to_json(hints).alias("metadata"))


def user_prompt(metadata: str | Column) -> Column:
    """What a relation model is asked: hints and both documents in full."""
    part = lambda s: F.concat(F.lit(f"Document {s.upper()} ("), f"url_{s}", F.lit("):\n"), f"text_{s}")
    return F.concat(F.lit("Hints from retrieval, no proof: "), T.col(metadata), F.lit("\n\n"), part("a"), F.lit("\n\n"), part("b"))


def derived_relation(v: str | Column) -> Column:
    v = T.col(v)
    comparable = F.lit(True)
    for k in FLAGS[:3]:
        comparable &= F.coalesce(v[k], F.lit(False))
    return F.when(~comparable, "none").when(F.coalesce(v["values_compatible"], F.lit(False)), "support").otherwise("conflict")


def relation_error(v: str | Column) -> Column:
    """The first thing wrong with a relation judgment, or null."""
    v = T.col(v)
    return F.coalesce(
        F.when(~F.coalesce(v["relation"].isin(C.RELATIONS), F.lit(False)), "invalid relation"),
        *[F.when(v[k].isNull(), f"{k} must be a boolean") for k in FLAGS],
        *[F.when(v[k].isNull(), f"{k} must be a string") for k in ("subject", "attribute", "value_a", "value_b", "evidence_a", "evidence_b", "reason")],
        F.when(v["confidence"].isNull(), "confidence must be a number"),
        F.when(~v["confidence"].between(0.0, 1.0), "confidence must be in [0, 1]"),
    )


def usable_relations(rows: DataFrame) -> DataFrame:
    """rows: pair_id, doc_a_id, doc_b_id, status, relation, confidence, seq.  Of each pair the most confident row, the first of equals."""
    good = rows.where("coalesce(status, 'success') = 'success'").where(F.col("relation").isin(C.RELATIONS))
    trust = F.coalesce("confidence", F.lit(0.0))
    one = good.groupBy("pair_id").agg(F.min_by(F.struct("doc_a_id", "doc_b_id", "relation", trust.alias("confidence"), "seq"), F.struct((-trust).alias("c"), "seq")).alias("r"))
    return one.select("pair_id", "r.*")


def relation_counts(rows: DataFrame) -> DataFrame:
    """One row: skipped rows, and rows before and after deduplication by relation."""
    ok = F.coalesce("status", F.lit("success")) == "success"
    known = F.coalesce(F.col("relation").isin(C.RELATIONS), F.lit(False))
    before = rows.agg(F.count_if(~ok).alias("errors_skipped"), F.count_if(ok & ~known).alias("invalid_skipped"), *[F.count_if(ok & (F.col("relation") == r)).alias(f"input_{r}") for r in C.RELATIONS])
    return before.crossJoin(usable_relations(rows).agg(*[F.count_if(F.col("relation") == r).alias(f"deduplicated_{r}") for r in C.RELATIONS]))


def endpoints(relations: DataFrame) -> DataFrame:
    """Support edges by each of their documents."""
    support = relations.where("relation = 'support'")
    return support.select(F.explode(F.array("doc_a_id", "doc_b_id")).alias("endpoint"), "pair_id", "doc_a_id", "doc_b_id", "confidence")


def seeds(conflicts: DataFrame, support: DataFrame) -> DataFrame:
    """Conflicts with the number of support edges at either document."""
    n = endpoints(support).groupBy("endpoint").agg(F.count("*").alias("n"))
    side = lambda s: n.select(F.col("endpoint").alias(f"doc_{s}_id"), F.col("n").alias(f"n_{s}"))
    out = conflicts.where("relation = 'conflict'").join(side("a"), "doc_a_id", "left").join(side("b"), "doc_b_id", "left")
    return out.fillna(0, ["n_a", "n_b"]).withColumn("least", F.least("n_a", "n_b"))


def coverage(conflicts: DataFrame, support: DataFrame, min_support: int = 1) -> DataFrame:
    s = seeds(conflicts, support)
    return s.agg(
        F.count("*").alias("conflicts"), F.count_if(F.col("n_a") > 0).alias("left_supported"), F.count_if(F.col("n_b") > 0).alias("right_supported"),
        F.count_if(F.col("least") > 0).alias("both_supported"), F.count_if(F.col("least") < min_support).alias("insufficient_support"),
    )


def subgraphs(conflicts: DataFrame, support: DataFrame | None = None, per_endpoint: int = 2, min_support: int = 1, most: int = 0) -> DataFrame:
    """One row per eligible conflict: its id, ordered support pair ids per side, and its documents.

    ``per_endpoint`` 0 takes all support edges, ``most`` 0 all conflicts.
    """
    support = conflicts if support is None else support
    ok = seeds(conflicts, support).where(F.col("least") >= min_support)
    if most > 0:
        ok = ok.orderBy(F.desc("least"), F.desc("confidence"), "pair_id").limit(most)
    ok = ok.select(F.col("pair_id").alias("seed"), "doc_a_id", "doc_b_id", "confidence", "least")
    e = endpoints(support).withColumnsRenamed({"pair_id": "edge", "confidence": "trust", "doc_a_id": "from_id", "doc_b_id": "to_id"})
    rank = F.row_number().over(W.partitionBy("endpoint").orderBy(F.desc("trust"), "edge"))
    # an edge between both documents of a seed counts for the first of them, so one more may be needed
    e = e.withColumn("r", rank)
    if per_endpoint > 0:
        e = e.where(F.col("r") <= 2 * per_endpoint)
    ends = ok.select("seed", F.posexplode(F.array("doc_a_id", "doc_b_id")).alias("side", "endpoint")).join(e, "endpoint")
    keep = lambda df: df.withColumn("k", F.row_number().over(W.partitionBy("seed", "side").orderBy("r"))).where(F.col("k") <= per_endpoint if per_endpoint > 0 else F.lit(True))
    left = keep(ends.where("side = 0"))
    right = keep(ends.where("side = 1").join(left.select("seed", "edge"), ["seed", "edge"], "left_anti").select(*ends.columns))
    edges = left.unionByName(right).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("side", "k", "edge"))).alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("from_id", "to_id"))))).alias("ids"))
    out = ok.join(edges, "seed", "left")
    nodes = F.array_sort(F.array_distinct(F.concat(F.array("doc_a_id", "doc_b_id"), F.coalesce("ids", F.array().cast("array<string>")))))
    return out.select(F.concat(F.lit("subgraph-"), "seed").alias("subgraph_id"), F.col("seed").alias("pair_id"), "confidence", "least", F.coalesce(F.col("e.edge"), F.array().cast("array<string>")).alias("support_edges"), nodes.alias("node_ids"))


def attach_documents(graphs: DataFrame, docs: DataFrame) -> DataFrame:
    """Subgraphs with their documents; raises if the store lacks one.  docs: doc_id, url, text."""
    ids = graphs.select("subgraph_id", F.explode("node_ids").alias("doc_id"))
    if ids.join(docs, "doc_id", "left_anti").limit(1).count():
        raise ValueError("a document of a subgraph is missing from the store")
    rows = ids.join(docs.select("doc_id", "url", "text"), "doc_id").groupBy("subgraph_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "url", "text"))).alias("documents"))
    return graphs.join(rows, "subgraph_id")
