"""Export of verified questions: the three-way join with reasons, two records per group, ids made from content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.sources.lookups import latest


def made_uuid(*parts: Column) -> Column:
    """A canonical UUID (version 5 layout) from SHA-1, so that a rerun gives the same ids."""
    h = F.sha1(F.concat_ws("\0", *parts))
    nibble = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), nibble, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def decisions(synthesis: DataFrame, sources: DataFrame, verification: DataFrame, order: str = "seq") -> DataFrame:
    """Verification rows with the reason why they are not exported (null for exported ones) and their question."""
    kept = lambda d: (F.col("status") == "success") & F.coalesce(F.col(f"{d}.keep"), F.lit(False)) & F.coalesce(F.col(f"{d}.verdict") == "verified", F.lit(False))
    v = latest(verification, order=order).select("subgraph_id", F.coalesce(F.col("status") == "success", F.lit(False)).alias("v_ok"), kept("verification").alias("v_kept"))
    s = latest(sources, order=order).select("subgraph_id", kept("validation").alias("s_kept"))
    q = latest(synthesis, order=order).select("subgraph_id", ((F.col("status") == "success") & F.coalesce("qa.keep", F.lit(False))).alias("q_kept"), "qa")
    rows = v.join(s, "subgraph_id", "left").join(q, "subgraph_id", "left")
    reason = F.when(~F.col("v_ok"), "verification_error").when(~F.coalesce("v_kept", F.lit(False)), "verification_rejected").when(~F.coalesce("s_kept", F.lit(False)), "source_validation_rejected")
    return rows.select("subgraph_id", reason.alias("reason"), F.coalesce("q_kept", F.lit(False)).alias("q_kept"), "qa")


def export_records(synthesis: DataFrame, sources: DataFrame, verification: DataFrame, order: str = "seq") -> DataFrame:
    """benchmark_id, item_group_id, formulation, eval; raises where a verified row has no usable question."""
    good = decisions(synthesis, sources, verification, order).where("reason is null")
    forms = F.array_sort(F.array_distinct("qa.questions.formulation"))
    bad = ~F.col("q_kept") | ~F.coalesce(forms == F.array_sort(F.array(*map(F.lit, C.FORMULATIONS))), F.lit(False))
    if good.where(bad).limit(1).count():
        raise ValueError("a verified subgraph has no usable pair of questions")
    rows = good.select("subgraph_id", F.explode(F.array(*map(F.lit, C.FORMULATIONS))).alias("formulation"), "qa")
    asked = F.filter("qa.questions", lambda x: x["formulation"] == F.col("formulation"))
    ev = F.struct(
        F.try_element_at(asked, F.lit(-1))["question"].alias("question"),
        F.transform("qa.gold_answers", lambda a: F.struct(F.coalesce(a["value"], F.lit("")).alias("value"))).alias("gold_answers"),
        F.coalesce("qa.preferred_answer", F.lit("")).alias("preferred_answer"),
    )
    return rows.select(made_uuid(F.col("subgraph_id"), F.col("formulation")).alias("benchmark_id"), made_uuid(F.col("subgraph_id")).alias("item_group_id"), "formulation", ev.alias("eval"))
