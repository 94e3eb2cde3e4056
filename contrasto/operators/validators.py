"""Deterministic checks of model outputs, each an array of error messages as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions import text as T

_NONE = "array<string>"
CHECKS = ("same_subject", "same_attribute", "same_fact_context", "qa_valid")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _errors(*parts: Column) -> Column:
    """Single messages (null for none) and arrays of them, in order."""
    return F.array_compact(F.concat(*[F.coalesce(p, F.array().cast(_NONE)) for p in parts]))


def _one(condition: Column, message: str | Column) -> Column:
    return F.array(F.when(F.coalesce(condition, F.lit(False)), message))


def _each(items: Column, *rules) -> Column:
    """Messages of numbered items; a rule maps (item, index as text) to an array."""
    return F.flatten(F.transform(F.coalesce(items, F.array()), lambda x, i: _errors(*[r(x, i.cast("string")) for r in rules])))


def _texts(documents: Column, key: str = "doc_id") -> Column:
    """Map of document ids to comparable texts; the last of equal ids counts."""
    known = F.filter(documents, lambda d: ~_blank(d[key]))
    entries = F.transform(known, lambda d: F.struct(d[key], T.normalize_text(d["text"])))
    return F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>"))


def _holds(text: Column, quote: Column) -> Column:
    return (quote != "") & F.coalesce(F.contains(text, quote), F.lit(False))


def qa_errors(qa: str | Column = "qa", documents: str | Column = "documents") -> Column:
    """A paired question and its gold answers against the documents of a subgraph."""
    q, texts = T.col(qa), _texts(T.col(documents))
    said = F.coalesce(q["questions"], F.array()), F.coalesce(q["gold_answers"], F.array())
    forms = F.array_sort(F.array_distinct(F.transform(q["questions"], lambda x: F.coalesce(x["formulation"], F.lit("")))))
    two, many = F.coalesce(F.size(q["questions"]) == 2, F.lit(False)), F.coalesce(F.size(q["gold_answers"]) >= 2, F.lit(False))
    named = lambda i, what: F.concat(F.lit("gold answer "), i, F.lit(what))

    def spans(a: Column, i: Column) -> Column:
        quote = lambda s: T.normalize_text(s["quote"])
        unknown = lambda s: ~F.coalesce(F.map_contains_key(texts, F.coalesce(s["doc_id"], F.lit(""))), F.lit(False)) | (quote(s) == "")
        bad = F.transform(a["evidence_spans"], lambda s: F.when(unknown(s), named(i, " has invalid evidence reference")).when(~_holds(F.try_element_at(texts, s["doc_id"]), quote(s)), named(i, " evidence is not verbatim")))
        return F.when(F.coalesce(F.size(a["evidence_spans"]), F.lit(0)) < 1, F.array(named(i, " has no evidence spans"))).otherwise(bad)

    def support(a: Column, i: Column) -> Column:
        ids = a["supporting_doc_ids"]
        return F.array(F.when(F.coalesce(F.size(ids), F.lit(0)) < 1, named(i, " has no supporting_doc_ids")).when(F.size(F.array_except(ids, F.map_keys(texts))) > 0, named(i, " references an unknown document")))

    answers = F.when(many, q["gold_answers"])
    values = F.filter(F.transform(answers, lambda a: T.normalize_text(a["value"])), lambda v: v != "")
    leak = lambda x: F.exists(F.coalesce(values, F.array().cast(_NONE)), lambda v: (F.length(v) >= 3) & F.contains(T.normalize_text(x["question"]), v))
    kept = _errors(
        *[_one(_blank(q[f]), f"{f} must be a non-empty string") for f in ("subject", "attribute", "preferred_answer")],
        _one(~two, "exactly two questions are required"),
        _one(F.when(two, F.coalesce(forms != F.array_sort(F.array(*map(F.lit, C.FORMULATIONS))), F.lit(True))).otherwise(True), "questions must contain named_entity and clue_based"),
        _one(~many, "at least two gold answers are required"),
        _each(answers, lambda a, i: _one(_blank(a["value"]), named(i, " has empty value")), support, spans),
        _one(F.size(values) != F.size(F.array_distinct(values)), "gold answer values must be distinct"),
        F.transform(F.when(two, q["questions"]), lambda x: F.when(_blank(x["question"]), "question text must be non-empty").when(leak(x), "question leaks a gold answer")),
    )
    dropped = _errors(
        _one(_blank(q["rejection_reason"]), "keep=false requires rejection_reason"), _one(F.size(said[0]) > 0, "keep=false requires empty questions"), _one(F.size(said[1]) > 0, "keep=false requires empty gold_answers")
    )
    return F.when(q["keep"].isNull(), F.array(F.lit("keep must be boolean"))).when(q["keep"], kept).otherwise(dropped)


def _decision(r: Column, verdicts: list[str], verdict_message: str) -> list[Column]:
    return [
        _one(r["keep"].isNull(), "keep must be boolean"),
        _one(~F.coalesce(r["verdict"].isin(verdicts), F.lit(False)), verdict_message),
        *[_one(r[k].isNull(), f"{k} must be boolean") for k in CHECKS],
        _one(_blank(r["reason"]), "reason must be a non-empty string"),
    ]


def _cover(r: Column, golds: Column, flag: str) -> tuple[Column, Column, Column]:
    """(expected values, values seen, whether every check has its flag)."""
    expected = F.array_distinct(F.transform(F.coalesce(golds, F.array()), lambda a: T.normalize_text(a["value"])))
    checks = F.coalesce(r["answer_verifications"], F.array())
    seen = F.transform(checks, lambda c: T.normalize_text(c["value"]))
    return expected, seen, F.forall(checks, lambda c: F.coalesce(c[flag], F.lit(False)))


def _value_rules(expected: Column, seen: Column):
    named = lambda i, what: F.concat(F.lit("answer verification "), i, F.lit(what))
    unknown = lambda c, i: _one(~F.array_contains(expected, T.normalize_text(c["value"])), named(i, " has an unknown value"))
    twice = lambda c, i: _one(F.array_position(seen, T.normalize_text(c["value"])) <= i.cast("int"), named(i, " duplicates a value"))
    return named, unknown, twice


def source_errors(result: str | Column = "validation", qa: str | Column = "qa", documents: str | Column = "documents") -> Column:
    """A decision on a question from the documents of its subgraph alone."""
    r, texts = T.col(result), _texts(T.col(documents))
    expected, seen, every = _cover(r, T.col(qa)["gold_answers"], "supported")
    named, unknown, twice = _value_rules(expected, seen)
    all_seen = F.array_sort(F.array_distinct(seen)) == F.array_sort(expected)

    def spans(c: Column, i: Column) -> Column:
        bad = lambda s: F.when(~F.coalesce(F.map_contains_key(texts, F.coalesce(s["doc_id"], F.lit(""))), F.lit(False)), named(i, " cites an unknown document")).when(~_holds(F.try_element_at(texts, s["doc_id"]), T.normalize_text(s["quote"])), named(i, " evidence is not verbatim"))
        return F.transform(c["evidence_spans"], bad)

    keep = F.coalesce(r["keep"], F.lit(False))
    passed = F.lit(True)
    for k in CHECKS:
        passed &= F.coalesce(r[k], F.lit(False))
    return _errors(
        *_decision(r, ["verified", "rejected"], "verdict must be verified or rejected"),
        _one(r["answer_verifications"].isNull(), "answer_verifications must be a list"),
        _each(
            r["answer_verifications"], unknown, twice,
            lambda c, i: _one(c["supported"].isNull(), named(i, " supported must be boolean")),
            lambda c, i: _one(c["evidence_spans"].isNull(), named(i, " evidence_spans must be a list")),
            lambda c, i: _one(F.coalesce(c["supported"], F.lit(False)) & (F.coalesce(F.size(c["evidence_spans"]), F.lit(0)) < 1), named(i, " claims support without evidence")),
            spans, lambda c, i: _one(_blank(c["reason"]), named(i, " reason must be non-empty")),
        ),
        _one(~all_seen, "answer_verifications must cover every gold answer exactly once"),
        _one(keep & ~F.coalesce(r["verdict"] == "verified", F.lit(False)), "keep=true requires verdict=verified"),
        _one(keep & ~passed, "keep=true requires every comparability and QA check to pass"),
        _one(keep & ~(every & all_seen), "keep=true requires full-document support for every answer"),
        _one(~keep & (r["verdict"] == "verified"), "verdict=verified requires keep=true"),
    )


def web_errors(result: str | Column, qa: str | Column, fetched: str | Column, seed_urls: str | Column) -> Column:
    """A decision from web sources.  fetched: array<struct<source_id, urls:array<string>, text>> with canonical URLs; seed_urls: canonical."""
    r, seeds = T.col(result), T.col(seed_urls)
    found = F.coalesce(F.map_from_entries(F.transform(T.col(fetched), lambda f: F.struct(f["source_id"], F.struct(f["urls"].alias("urls"), T.normalize_text(f["text"]).alias("text"))))), F.create_map().cast("map<string,struct<urls:array<string>,text:string>>"))
    expected, seen, every = _cover(r, T.col(qa)["gold_answers"], "verified")
    named, unknown, twice = _value_rules(expected, seen)

    def sources(c: Column, i: Column) -> Column:
        def bad(s: Column) -> Column:
            f = F.try_element_at(found, F.coalesce(s["source_id"], F.lit("")))
            reuse = F.arrays_overlap(F.filter(f["urls"], lambda u: u != ""), F.coalesce(seeds, F.array().cast(_NONE)))
            known = F.array(F.when(reuse, named(i, " reuses a seed document as independent evidence")), F.when(~_holds(f["text"], T.normalize_text(s["quote"])), named(i, " quote is not verbatim fetched text")))
            return F.when(f.isNull(), F.array(named(i, " cites an unfetched source"))).otherwise(known)

        return F.flatten(F.transform(F.coalesce(c["sources"], F.array()), bad))

    keep = F.coalesce(r["keep"], F.lit(False))
    passed = F.lit(True)
    for k in CHECKS:
        passed &= F.coalesce(r[k], F.lit(False))
    return _errors(
        *_decision(r, ["verified", "rejected", "insufficient_evidence"], "invalid verdict"),
        _one(r["answer_verifications"].isNull(), "answer_verifications must be a list"),
        _each(
            r["answer_verifications"], unknown, twice,
            lambda c, i: _one(c["sources"].isNull(), named(i, " sources must be a list")),
            lambda c, i: _one(F.coalesce(c["verified"], F.lit(False)) & (F.coalesce(F.size(c["sources"]), F.lit(0)) < 1), named(i, " claims verification without a source")),
            sources,
        ),
        _one(F.array_sort(F.array_distinct(seen)) != F.array_sort(expected), "answer_verifications must cover every gold answer exactly once"),
        _one(keep & ~F.coalesce(r["verdict"] == "verified", F.lit(False)), "keep=true requires verdict=verified"),
        _one(keep & ~passed, "keep=true requires all comparability and QA checks to pass"),
        _one(keep & ~(every & (F.size(F.array_distinct(seen)) == F.size(expected))), "keep=true requires independent web evidence for every answer"),
    )
