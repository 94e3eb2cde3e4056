"""Recall of known pairs: of the candidates, of blocking, and of the preparation filters, with reasons for misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.operators import candidates as K


def pair_recall(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """One row: known and recovered pairs and the share.  known: left < right."""
    hit = known.join(candidates.select(F.col("doc_a").alias("left"), F.col("doc_b").alias("right")).distinct().withColumn("hit", F.lit(1)), ["left", "right"], "left")
    return hit.agg(F.count("*").alias("known_pairs"), F.count("hit").alias("recovered_pairs")).withColumn("recall", F.try_divide("recovered_pairs", "known_pairs"))


def recall_by_signal(candidates: DataFrame, known: DataFrame) -> DataFrame:
    c = candidates.select(F.col("doc_a").alias("left"), F.col("doc_b").alias("right"), F.explode("retrieval_signals").alias("signal"))
    return c.join(known, ["left", "right"], "left_semi").groupBy("signal").agg(F.count("*").alias("recovered"))


def missing_examples(candidates: DataFrame, known: DataFrame, most: int = 20) -> DataFrame:
    """The first missing pairs: a report of bounded size."""
    c = candidates.select(F.col("doc_a").alias("left"), F.col("doc_b").alias("right"))
    return known.join(c, ["left", "right"], "left_anti").orderBy("left", "right").limit(most)


def blocked(anchors: DataFrame, known: DataFrame) -> DataFrame:
    """Known pairs whose documents share a bucket of a route (across knowledge points on ``ner``)."""
    m = K.members(K.routes(anchors)).select(*K.BUCKET, "doc_id", "kp_key")
    l = m.select(*K.BUCKET, F.col("doc_id").alias("left"), F.col("kp_key").alias("lk"))
    r = m.select(*K.BUCKET, F.col("doc_id").alias("right"), F.col("kp_key").alias("rk"))
    both = known.join(l, "left").join(r, ["right", *K.BUCKET])
    return both.where("route = 'kp' or lk <> rk").select("left", "right", "route").distinct()


def audit_blocking(anchors: DataFrame, known: DataFrame) -> DataFrame:
    """(left, right, reason) of known pairs; reason is null for recovered ones.

    Anchors are looked up per known pair, so the sets compared are those of single documents.
    """
    have = anchors.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"), F.collect_set("slot").alias("slots"))
    side = lambda s: have.select(F.col("doc_id").alias(s), F.col("subjects").alias(f"{s}_subjects"), F.col("slots").alias(f"{s}_slots"))
    got = blocked(anchors, known).select("left", "right").distinct().withColumn("got", F.lit(True))
    rows = known.join(got, ["left", "right"], "left").join(side("left"), "left", "left").join(side("right"), "right", "left")
    reason = F.when(F.col("left_subjects").isNull() | F.col("right_subjects").isNull(), "endpoint_missing_anchor")
    reason = reason.when(~F.arrays_overlap("left_subjects", "right_subjects"), "no_shared_subject").when(~F.arrays_overlap("left_slots", "right_slots"), "no_shared_slot").otherwise("no_shared_subject_slot_combination")
    return rows.select("left", "right", F.when(F.col("got").isNull(), reason).alias("reason"))


def audit_preparation(anchors: DataFrame, known: DataFrame) -> DataFrame:
    """(left, right, reason): a pair is recovered if two anchors agree in subject and slot, and in knowledge point or in both having scope ``all``.

    Unlike blocking this asks for equal slots across knowledge points too.
    """
    a = anchors.select("doc_id", "subject", "slot", "kp_key", F.coalesce("alias_scope", F.lit("all")).alias("scope")).distinct()
    l = a.select(F.col("doc_id").alias("left"), "subject", "slot", F.col("kp_key").alias("lk"), F.col("scope").alias("ls"))
    r = a.select(F.col("doc_id").alias("right"), "subject", "slot", F.col("kp_key").alias("rk"), F.col("scope").alias("rs"))
    match = known.join(l, "left").join(r, ["right", "subject", "slot"]).where("lk = rk or (ls = 'all' and rs = 'all')").select("left", "right").distinct().withColumn("got", F.lit(True))
    have = anchors.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"), F.collect_set("slot").alias("slots"))
    side = lambda s: have.select(F.col("doc_id").alias(s), F.col("subjects").alias(f"{s}_subjects"), F.col("slots").alias(f"{s}_slots"))
    rows = known.join(match, ["left", "right"], "left").join(side("left"), "left", "left").join(side("right"), "right", "left")
    reason = F.when(F.col("left_subjects").isNull() | F.col("right_subjects").isNull(), "endpoint_missing_anchor")
    reason = reason.when(~F.arrays_overlap("left_subjects", "right_subjects"), "no_shared_subject").when(~F.arrays_overlap("left_slots", "right_slots"), "no_shared_slot").otherwise("no_shared_subject_slot_combination")
    return rows.select("left", "right", F.when(F.col("got").isNull(), reason).alias("reason"))
