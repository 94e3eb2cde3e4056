"""Web verification of a question from a trace of tool calls: budgets, corrections, and the outcome for bad quotations.

A trace is what an agent did: searches (queries, in order), fetches (requested_url, url, text; in order) and finals (its
answers, in order).  The rules are applied to the trace as a table, so live agents and replays are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasto.functions import text as T
from contrasto.operators import validators
from contrasto.operators.evaluation import json_object


@dataclass(frozen=True)
class VerificationConfig:
    search_budget: int = 3
    fetch_budget: int = 5
    max_steps: int = 12
    final_retries: int = 1


RESULT = (
    "keep boolean, verdict string, same_subject boolean, same_attribute boolean, same_fact_context boolean, qa_valid boolean, "
    "answer_verifications array<struct<value:string,verified:boolean,sources:array<struct<source_id:string,url:string,quote:string>>,reason:string>>, reason string"
)
# ---- fixed value: the reason given when quotations can't be made exact
NO_QUOTATION = "Automatic verification could not provide an exact quotation from the fetched pages."


def seed_urls(documents: str | Column) -> Column:
    """Canonical URLs of a subgraph's documents (an array column of urls)."""
    return _canonical_all(F.transform(T.col(documents), lambda d: F.coalesce(d["url"], F.lit(""))))


def _canonical_all(urls: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[u for u in map(T._canonical, x) if u] if x is not None else [] for x in s], dtype=object)

    return F.pandas_udf(run, "array<string>")(urls)


def fetched_sources(trace: str | Column, budget: int) -> Column:
    """array<struct<source_id, urls, text>>: distinct addresses in order, as many as the budget allows."""

    def run(s: pd.Series) -> pd.Series:
        out = []
        for fetches in s:
            known, found = set(), []
            for f in fetches if fetches is not None else []:
                asked, url = (f["requested_url"] or "").strip(), f["url"] or ""
                if asked in known or len(found) >= budget:
                    continue
                known |= {asked, url}
                found.append({"source_id": f"source-{len(found) + 1}", "urls": [T._canonical(url), T._canonical(asked)], "text": f["text"] or ""})
            out.append(found)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<source_id:string,urls:array<string>,text:string>>")(T.col(trace)["fetches"])


def insufficient(qa: Column, attempted: Column) -> Column:
    """The decision when only quotations were wrong: nothing verified, nothing kept."""
    flag = lambda k: F.coalesce(attempted[k], F.lit(True)).alias(k)
    none = F.array().cast("array<struct<source_id:string,url:string,quote:string>>")
    checks = F.transform(qa["gold_answers"], lambda a: F.struct(F.coalesce(a["value"], F.lit("")).alias("value"), F.lit(False).alias("verified"), none.alias("sources"), F.lit(NO_QUOTATION).alias("reason")))
    return F.struct(F.lit(False).alias("keep"), F.lit("insufficient_evidence").alias("verdict"), *[flag(k) for k in validators.CHECKS], checks.alias("answer_verifications"), F.lit(NO_QUOTATION).alias("reason"))


def judge_traces(rows: DataFrame, config: VerificationConfig = VerificationConfig()) -> DataFrame:
    """rows: subgraph_id, qa, documents, trace.  Returns subgraph_id, status, verification, error, attempts, searches."""
    r = rows.withColumn("seeds", seed_urls("documents")).withColumn("fetched", fetched_sources("trace", config.fetch_budget))
    golds = F.size("qa.gold_answers")
    searches = F.least(F.coalesce(F.size("trace.searches"), F.lit(0)), F.lit(config.search_budget))
    r = r.withColumn("searches", searches)
    tries = config.final_retries + 1
    for k in range(tries):
        final = F.get("trace.finals", F.lit(k))
        r = r.withColumn(f"v{k}", F.from_json(json_object(final), RESULT))
        errors = F.concat(validators.web_errors(f"v{k}", "qa", "fetched", "seeds"), F.when(F.col("searches") < golds, F.array(F.lit("verification must use WebSearch separately for every proposed answer"))).otherwise(F.array().cast("array<string>")))
        r = r.withColumn(f"e{k}", F.when(final.isNull(), F.array(F.lit("no final answer"))).when(F.col(f"v{k}").isNull(), F.array(F.lit("not a JSON object"))).otherwise(errors))
    good = [F.size(f"e{k}") == 0 for k in range(tries)]
    last = f"e{tries - 1}"
    quotes = (F.size(last) > 0) & F.forall(last, lambda e: F.contains(e, F.lit("quote is not verbatim fetched text")))
    small = F.lit(config.search_budget) < golds
    value = F.coalesce(*[F.when(g, F.col(f"v{k}")) for k, g in enumerate(good)], F.when(quotes, insufficient(F.col("qa"), F.col(f"v{tries - 1}")).cast(f"struct<{_struct(RESULT)}>")))
    error = F.when(small, F.concat(F.lit(f"search budget {config.search_budget} is smaller than the "), golds.cast("string"), F.lit(" proposed answers"))).when(value.isNull(), F.array_join(last, "; "))
    attempts = F.when(small, 0)
    for k, g in enumerate(good):
        attempts = attempts.when(g, k + 1)
    return r.select("subgraph_id", F.when(error.isNull(), "success").otherwise("error").alias("status"), F.when(~small, value).alias("verification"), error.alias("error"), attempts.otherwise(tries).alias("attempts"), "searches")


def _struct(ddl: str) -> str:
    """Fields of a DDL schema as fields of a struct type."""
    depth, out, start = 0, [], 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[start:k].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = k + 1
    return ",".join(out)
