"""Preparation: tag rows and entity rows to anchors (document, subject, slot), with a reason for every document left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrasto.functions import entities as E
from contrasto.functions import text as T
from contrasto.sources.tables import materialize


@dataclass(frozen=True)
class PreparationConfig:
    min_confidence: float = 0.9
    min_evidence_chars: int = 60
    max_subjects: int = 2
    max_tokens: int = 64
    language: str = "en"
    require_knowledge_bearing: bool = False
    subject_aliases: bool = False


def latest_entities(ner: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each document; a missing list is empty."""
    return ner.groupBy(*keys).agg(F.max_by("entities", order).alias("entities"))


def signals(tags: DataFrame, ner: DataFrame, config: PreparationConfig = PreparationConfig(), keys: list[str] | None = None) -> DataFrame:
    """Tag rows with their primary tag, signals, subjects, and ``reason`` (null for documents that stay).

    tags: document_id, language, is_knowledge_bearing, tags; ner: document_id, entities; both unique by ``keys``.
    """
    keys = keys or ["document_id"]
    rows = tags.join(ner, keys, "left").withColumn("tag", T.select_primary_tag("tags"))
    rows = rows.withColumn("evidence", T.normalize_space("tag.evidence")).withColumn("conf", F.coalesce("tag.confidence", F.lit(0.0)))
    rows = rows.withColumn("slots", T.extract_slots("evidence"))
    early = F.coalesce(
        F.when(F.coalesce("document_id", F.lit("")) == "", "missing_doc_id"),
        F.when(F.lit(config.require_knowledge_bearing) & ~F.coalesce("is_knowledge_bearing", F.lit(False)), "not_knowledge_bearing"),
        F.when((F.lit(config.language) != "") & (F.coalesce("language", F.lit("")) != "") & (F.col("language") != config.language), "wrong_language"),
        F.when(F.col("tag").isNull(), "missing_tag"),
        F.when(F.col("conf") < config.min_confidence, "low_confidence"),
        F.when(F.length("evidence") < config.min_evidence_chars, "short_evidence"),
        F.when(F.size("slots") == 0, "missing_slot"),
    )
    rows = rows.withColumn("early", early)
    # entity names need Python; rows that are out already send it nothing
    rows = rows.withColumn("subjects", E.select_subjects(F.when(F.col("early").isNull(), F.col("evidence")).otherwise(""), "entities", config.max_subjects))
    rows = rows.withColumn("reason", F.coalesce("early", F.when(F.size("subjects") == 0, "missing_subject"))).drop("early")
    # anchors, reasons and manifest all read this; written once, so the patterns run once, and without the lists it came from
    return materialize(rows.withColumn("missing_ner", F.col("entities").isNull()).drop("tags", "entities"), "signals")


def anchors(rows: DataFrame, domains: DataFrame | None = None, config: PreparationConfig = PreparationConfig()) -> DataFrame:
    """Anchors of the rows that stay.  domains: document_id, source_domain."""
    good = rows.where("reason is null").select(
        F.col("document_id").alias("doc_id"),
        F.struct(T.knowledge_point_key("tag").alias("key"), *[F.coalesce(F.col("tag")[k], F.lit("")).alias(k) for k in ("discipline", "field", "subfield")]).alias("knowledge_point"),
        F.round("conf", 6).alias("confidence"), "evidence", T.extract_dates("evidence").alias("dates"), T.extract_numbers("evidence").alias("numbers"),
        T.content_tokens("evidence", config.max_tokens).alias("tokens"), "slots", "subjects",
    )
    if domains is not None:
        good = good.join(domains.select(F.col("document_id").alias("doc_id"), "source_domain"), "doc_id", "left")
    else:
        good = good.withColumn("source_domain", F.lit(""))
    good = good.withColumn("source_domain", F.coalesce("source_domain", F.lit("")))
    one = good.select("*", F.posexplode("subjects").alias("i", "main")).select("*", F.posexplode(E.subject_variants("main", config.subject_aliases)).alias("j", "subject"))
    one = one.select("*", F.posexplode("slots").alias("k", "slot"))
    # the place of an anchor among those of its document; later steps break ties by it
    place = (F.col("i") * 1000 + F.col("j")) * 1000 + F.col("k")
    return one.select("doc_id", "knowledge_point", "confidence", "subject", "slot", "evidence", "dates", "numbers", "tokens", "source_domain", place.alias("place"))


def manifest(rows: DataFrame, made: DataFrame) -> DataFrame:
    """One row: input rows, documents and anchors made, and counts of reasons."""
    counts = rows.agg(F.count("*").alias("input_rows"), F.count_if("missing_ner").alias("missing_ner"))
    reasons = rows.where("reason is not null").groupBy("reason").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("reasons"))
    return counts.crossJoin(made.agg(F.count_distinct("doc_id").alias("documents_with_anchors"), F.count("*").alias("anchors"))).crossJoin(reasons)
