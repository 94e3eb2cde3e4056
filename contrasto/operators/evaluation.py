"""Scores of models: labels, fixed-denominator rates, the greedy coverage curve, judgments, dataset validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions import text as T
from contrasto.sources.tables import materialize

RANK = {"failed": 0, "partial": 1, "complete": 2}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def label_of(judgment_label: str | Column, has_judgment: str | Column, *credits: str | Column) -> Column:
    """A result's label: a judgment decides even if unknown (then null); else the first known credit."""
    known = _map(C.RESULT_LABELS)
    first = F.coalesce(*[F.try_element_at(known, F.lower(T.col(c))) for c in credits]) if credits else F.lit(None).cast("string")
    return F.when(T.col(has_judgment), F.try_element_at(known, F.lower(T.col(judgment_label)))).otherwise(first)


def guard_results(benchmark: DataFrame, results: DataFrame, *keys: str) -> None:
    """Raise on results of unknown items and on repeated ones."""
    unknown = results.join(benchmark, "benchmark_id", "left_anti").limit(1).count()
    twice = results.groupBy(*keys, "benchmark_id").count().where("count > 1").limit(1).count()
    if unknown or twice:
        raise ValueError("result of an item absent from the benchmark" if unknown else "repeated result of an item")


def rates(n: Column, complete: Column, partial: Column, failed: Column) -> list[Column]:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [share(complete, n).alias("c_rate"), share(partial, n).alias("p_rate"), share(failed, n).alias("f_rate"), share(complete, complete + partial).alias("k_rate")]


def summarize(benchmark: DataFrame, results: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Counts and rates over all benchmark items; results: benchmark_id, status, label (and model)."""
    keys = ["model"] if models is not None else []
    items = benchmark.select("benchmark_id").distinct()
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    per = results.join(items, "benchmark_id", "left_semi").groupBy(*keys).agg(
        F.count("*").alias("result_records"), F.count_if(good).alias("successes"), F.count_if(good & F.col("label").isNull()).alias("ungraded"),
        *[F.count_if(good & (F.col("label") == x)).alias(x) for x in ("complete", "partial")],
    )
    if keys:
        per = models.select(*keys).distinct().join(per, keys, "left").fillna(0)
    # items without a result need no row of their own: what is neither complete nor partial has failed
    out = per.crossJoin(F.broadcast(items.agg(F.count("*").alias("n"))))  # a single row
    out = out.withColumn("failed", F.col("n") - F.col("complete") - F.col("partial")).withColumn("missing_or_error", F.col("n") - F.col("successes"))
    return out.select(*keys, "n", "complete", "partial", "failed", "result_records", "missing_or_error", "ungraded", *rates(*[F.col(x) for x in ("n", "complete", "partial", "failed")]))


def oracle_curve(benchmark: DataFrame, results: DataFrame) -> DataFrame:
    """Models added one by one, each time the one with most items complete at best so far; ties to the smaller name.

    results: model, benchmark_id, label.  The loop is over models; each step is one aggregate over items.
    """
    spark = benchmark.sparkSession
    rank = _map({k: str(v) for k, v in RANK.items()})
    names = sorted(r[0] for r in results.select("model").distinct().collect())  # bounded by the number of models
    best = [F.max(F.when(F.col("model") == m, F.try_element_at(rank, "label").cast("int"))) for m in names]
    per = results.groupBy("benchmark_id").agg(*[F.coalesce(b, F.lit(0)).alias(f"m{k}") for k, b in enumerate(best)]) if names else None
    items = benchmark.select("benchmark_id").distinct()
    if per is not None:
        # written, as each step reads it; a cache would go with its executors
        items = materialize(items.join(per, "benchmark_id", "left").fillna(0), "curve")
    curve, chosen, left = [], [], list(range(len(names)))
    while left:
        tops = [F.greatest(F.lit(0), F.lit(0), *[F.col(f"m{j}") for j in [*chosen, k]]) for k in left]
        counts = items.agg(F.count("*"), *[F.count_if(t == r) for t in tops for r in (2, 1)]).first()
        gains = [(counts[1 + 2 * i], -k, i) for i, k in enumerate(left)]
        complete, _, i = max(gains)
        n, partial = counts[0], counts[2 + 2 * i]
        chosen.append(left.pop(i))
        curve.append((len(chosen), names[chosen[-1]], n, complete / n if n else 0.0, partial / n if n else 0.0, (n - complete - partial) / n if n else 0.0, complete / (complete + partial) if complete + partial else 0.0))
    return spark.createDataFrame(curve, "models int, added string, n long, c_rate double, p_rate double, f_rate double, k_rate double")


def judge_prompt(answer: str | Column, ev: str | Column = "eval") -> Column:
    """What a judge is asked: question, verified answers and the model's answer as JSON."""
    e = T.col(ev)
    return F.to_json(F.struct(e["question"].alias("question"), F.transform(e["gold_answers"], lambda g: g["value"]).alias("verified_answers"), T.col(answer).alias("model_answer")))


def judged(responses: DataFrame, benchmark: DataFrame, answers: DataFrame) -> DataFrame:
    """Responses with labels from a judge's texts.  answers: benchmark_id, raw.

    Failed responses keep their status; a judge's failure leaves the response a success whose label is failed.
    """
    rows = responses.join(benchmark.select("benchmark_id", "eval"), "benchmark_id").join(answers, "benchmark_id", "left")
    j = parse_judgment("raw", F.size("eval.gold_answers"))
    rows = rows.withColumn("j", j)
    return rows.select("benchmark_id", "status", F.when(F.col("status") == "success", F.coalesce("j.label", F.lit("failed"))).alias("label"), F.when(F.col("status") == "success", F.coalesce("j.error", F.when(F.col("raw").isNull(), "no answer of the judge"))).alias("judge_error"))


JUDGMENT = "label string, credit string, rationale string, reasoning string, gold_assessments array<struct<covered:boolean,evidence:string>>, material_contradictions array<struct<claim:string,reason:string>>"


def json_object(x: str | Column) -> Column:
    """The JSON object in a model's text: a fenced one, else from the first to the last brace."""

    def found(text: Column) -> Column:
        fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
        return T.let(fenced, lambda f: F.when(f != "", f).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))

    return T.let(F.trim(T.col(x)), found)


def parse_judgment(x: str | Column, gold_count: str | Column | None = None) -> Column:
    """struct<label, rationale, covered, contradictions, error>; label is null where error is not."""
    # every name stands for a value computed once: the text is parsed once however often the checks read it
    def read(v: Column) -> Column:
        raw = F.lower(F.trim(F.coalesce(F.nullif(v["label"], F.lit("")), v["credit"], F.lit(""))))
        covered = F.size(F.filter(v["gold_assessments"], lambda g: g["covered"]))
        rationale = F.trim(F.coalesce(F.nullif(v["rationale"], F.lit("")), v["reasoning"], F.lit("")))
        return T.let(F.struct(F.try_element_at(_map(C.JUDGE_LABELS), raw).alias("label"), covered.alias("covered"), F.size(v["material_contradictions"]).alias("contradictions"), rationale.alias("rationale")), lambda s: checked(v, s))

    def checked(v: Column, s: Column) -> Column:
        golds, contradictions, label, covered = v["gold_assessments"], v["material_contradictions"], s["label"], s["covered"]
        expect = F.when((s["contradictions"] > 0) | (covered == 0), "failed").when(covered == F.size(golds), "complete").otherwise("partial")
        given = golds.isNotNull() | contradictions.isNotNull()
        checks = [
            F.when(label.isNull(), "unknown judge label or credit"),
            F.when(given & golds.isNull(), "gold_assessments must be an array"),
            F.when(given & F.exists(golds, lambda g: g["covered"].isNull()), "each gold assessment requires a boolean covered field"),
            F.when(given & contradictions.isNull(), "material_contradictions must be an array"),
            F.when(given & (label != expect), "judge credit is inconsistent with coverage"),
        ]
        if gold_count is not None:
            checks.insert(2, F.when(given & (F.size(golds) != T.col(gold_count)), "gold_assessments has another number of entries"))
        return T.let(F.coalesce(*checks), lambda error: F.struct(F.when(error.isNull(), label).alias("label"), s["rationale"].alias("rationale"), covered.alias("covered"), s["contradictions"].alias("contradictions"), error.alias("error")))

    return T.let(F.from_json(json_object(x), JUDGMENT), read)


def item_errors() -> Column:
    """Errors of a benchmark item (columns benchmark_id, item_group_id, eval) as an array."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def identifier(name: str) -> Column:
        return F.when(blank(F.col(name)), f"{name} must be a non-empty string").when(~T.is_canonical_uuid(name), f"{name} must be a canonical UUID string")

    ev = F.col("eval")
    golds = ev["gold_answers"]
    values = F.transform(F.filter(golds, lambda g: ~blank(g["value"])), lambda g: T.fold(F.trim(g["value"])))
    inside = F.concat(
        F.array(
            F.when(blank(ev["question"]), "eval.question must be a non-empty string"),
            F.when(blank(ev["preferred_answer"]), "eval.preferred_answer must be a non-empty string"),
            F.when(golds.isNull(), "eval.gold_answers must be a list").when(F.size(golds) < 2, "eval.gold_answers must contain at least two items"),
        ),
        F.coalesce(F.transform(golds, lambda g, i: F.when(blank(g["value"]), F.concat(F.lit("eval.gold_answers["), i.cast("string"), F.lit("].value must be a non-empty string")))), F.array().cast("array<string>")),
        F.array(F.when(F.size(values) != F.size(F.array_distinct(values)), "eval.gold_answers must not contain duplicate values")),
    )
    outside = F.array(identifier("benchmark_id"), identifier("item_group_id"), F.when(ev.isNull(), "eval must be an object"))
    return F.array_compact(F.concat(outside, F.when(ev.isNotNull(), inside).otherwise(F.array().cast("array<string>"))))


def dataset_errors(items: DataFrame) -> DataFrame:
    """(line, error) of a dataset with a ``line`` column; group errors have a null line.

    First lines of ids and questions come from aggregates, so a frequent value does not gather its rows.
    """
    own = items.select("line", F.explode(item_errors()).alias("error"))
    ids = items.where("benchmark_id is not null").groupBy("benchmark_id").agg(F.min("line").alias("first"))
    ids = items.join(ids, "benchmark_id").where("line > first").select("line", F.concat(F.lit("duplicate benchmark_id "), "benchmark_id").alias("error"))
    asked = items.select("line", T.normalize_text("eval.question").alias("q")).where("q <> ''")
    first = asked.groupBy("q").agg(F.min("line").alias("first"))
    asked = asked.join(first, "q").where("line > first").select("line", F.concat(F.lit("duplicate normalized question (first seen on line "), F.col("first").cast("string"), F.lit(")")).alias("error"))
    groups = items.where("item_group_id <> ''").groupBy("item_group_id").agg(F.count("*").alias("n")).where("n < 2")
    groups = groups.select(F.lit(None).cast("long").alias("line"), F.concat(F.lit("item_group_id "), "item_group_id", F.lit(" contains fewer than two records")).alias("error"))
    return own.unionByName(ids).unionByName(asked).unionByName(groups)


def dataset_report(items: DataFrame) -> DataFrame:
    """One row of counts and whether the dataset is valid (an empty one is not)."""
    q = T.normalize_text("eval.question")
    counts = items.agg(F.count("*").alias("records"), F.count_distinct("benchmark_id").alias("unique_ids"), F.count_distinct(F.when(q != "", q)).alias("unique_questions"))
    groups = items.where("item_group_id <> ''").groupBy("item_group_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("item_groups"), F.count_if(F.col("n") < 2).alias("singleton_groups"))
    errors = dataset_errors(items).agg(F.count("*").alias("errors"))
    return counts.crossJoin(groups).crossJoin(errors).withColumn("valid", (F.col("errors") == 0) & (F.col("records") > 0))
