"""Entity names: normalisation, plausibility, subject choice and aliases."""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from contrasto.functions import constants as C
from contrasto.functions.text import _subject, col

_STRIP = string.whitespace + string.punctuation + C.ENTITY_STRIP_MORE


def entity_name(text: str | None) -> str:
    """One entity's normal form."""
    v = unicodedata.normalize("NFKC", text or "").replace("’", "'")
    v = re.sub(r"\s+", " ", re.sub(r"https?://\S+|\b[A-Za-z]+://", " ", v)).strip(_STRIP)
    v = re.sub(r"'s\b", "", v, flags=re.I).strip(_STRIP).casefold()
    v = re.sub(r"([(])\s+", r"\1", re.sub(r"\s+([,.;:/)])", r"\1", v)).strip(_STRIP)
    return C.ENTITY_ALIASES.get(v, v)


def plausible_entity(surface: str | None, name: str | None) -> bool:
    """Whether a surface form with its normal form looks like an entity rather than page furniture."""
    surface, name = surface or "", name or ""
    letters = sum(map(str.isalpha, name))
    if not 2 <= len(name) <= 120 or name in C.NAVIGATION_WORDS or name.isdigit() or len(name.split()) > 12:
        return False
    latin = "".join(re.findall("[A-Za-z]", surface))
    if len(name) == 2 and name not in C.TWO_LETTER_NAMES and not (len(latin) == 2 and latin.isupper()):
        return False
    if not letters or letters / len(name) < 0.35 or "\n" in surface or re.fullmatch(r"\d+([:/.-]\d+)+|[\W_]+", name):
        return False
    at = next((k for k, c in enumerate(surface) if c.isalpha()), None)
    if at is not None and surface[at].islower():
        # a name that begins in lower case needs a longer first word and a capital later on
        return len(surface.split()[0]) > 3 and any(map(str.isupper, surface[at + 1 :]))
    return True


def normalize_entity(x: str | Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(entity_name, na_action=None)

    return F.pandas_udf(run, "string")(F.coalesce(col(x), F.lit("")))


def reasonable_entity(surface: str | Column, name: str | Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([plausible_entity(x, y) for x, y in zip(a, b)], dtype=bool)

    return F.pandas_udf(run, "boolean")(F.coalesce(col(surface), F.lit("")), F.coalesce(col(name), F.lit("")))


SUBJECT = "text string, norm string, label string, mention_count int, first_start int"


def choose_subjects(evidence: str, entities, most: int) -> list[dict]:
    """The entities named in the evidence, the best first."""
    folded = unicodedata.normalize("NFKC", evidence).casefold()
    best: dict[str, tuple] = {}
    for e in entities if entities is not None else []:
        forms = [" ".join(v.split()) for v in [e["text"] or "", *(e["surface_forms"] if e["surface_forms"] is not None else [])] if v and v.split()]
        named = [v for v in forms if v.casefold() in folded]
        if not named:
            continue
        norm = _subject(e["text"] or named[0])
        if len(norm) < 3 or norm in C.GENERIC_SUBJECTS:
            continue
        label, count, start = (e["label"] or "misc").casefold(), int(e["count"] or 1), int(e["first_start"] or 0) or None
        display = max(named, key=lambda v: (len(v), v.casefold()))
        score = (C.LABEL_PRIORITY.get(label, 0), count, len(display.split()), -(start or 10**9), norm)
        if norm not in best or score > best[norm][0]:
            best[norm] = (score, {"text": display, "norm": norm, "label": label, "mention_count": count, "first_start": start})
    return [r for _, r in sorted(best.values(), key=lambda x: x[0], reverse=True)[:most]]


def select_subjects(evidence: str | Column, entities: str | Column, most: int = 2) -> Column:
    """array<struct<text, norm, label, mention_count, first_start>>; first_start 0 counts as unknown, count 0 as 1."""

    def run(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([choose_subjects(t or "", e, most) for t, e in zip(text, found)], dtype=object)

    return F.pandas_udf(run, f"array<struct<{SUBJECT.replace(' string', ':string').replace(' int', ':int')}>>")(col(evidence), col(entities))


def subject_variants(subject: str | Column, aliases: bool = False) -> Column:
    """A subject and, if wanted, its surname or acronym, with canonical_norm, alias_scope and alias_kind."""
    s = col(subject)

    def made(text: Column, norm: Column, scope: str, kind: str | None) -> Column:
        return F.struct(
            text.alias("text"), norm.alias("norm"), s["label"].alias("label"), s["mention_count"].alias("mention_count"), s["first_start"].alias("first_start"),
            s["norm"].alias("canonical_norm"), F.lit(scope).alias("alias_scope"), F.lit(kind).cast("string").alias("alias_kind"),
        )

    own = made(s["text"], s["norm"], "all", None)
    if not aliases:
        return F.array(own)
    words = F.filter(F.split(F.replace(s["norm"], F.lit("’"), F.lit("'")), r"\s+"), lambda w: w != "")
    last = F.regexp_replace(F.regexp_replace(F.try_element_at(words, F.lit(-1)), "'s$", ""), "^[-' ]+|[-' ]+$", "")
    initials = F.array_join(F.transform(F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}]")), lambda w: F.substring(w, 1, 1)), "")
    n = F.size(words)
    surname = F.when((s["label"] == "person") & n.between(2, 6) & (F.length(last) >= 4) & (last != s["norm"]), made(last, last, "kp", "person_surname"))
    acronym = F.when((s["label"] == "organization") & n.between(2, 8) & F.length(initials).between(3, 8) & (initials != s["norm"]), made(F.upper(initials), initials, "all", "organization_acronym"))
    return F.array_compact(F.array(own, surname, acronym))
