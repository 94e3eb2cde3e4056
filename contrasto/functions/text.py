"""Scalar functions over text as column expressions; Python (Arrow batches) only where Unicode rules need it."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from contrasto.functions import constants as C


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once: a lambda's variable, where a plain column would be computed at each use."""
    return F.transform(F.array(value), body)[0]


def normalize_space(x: str | Column) -> Column:
    """Null as empty, runs of Unicode white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def fold(x: str | Column) -> Column:
    """Case folding by way of upper case, so that sharp s and its like agree."""
    return F.lower(F.upper(col(x)))


def normalize_text(x: str | Column) -> Column:
    """The key by which quotations are compared."""
    return fold(normalize_space(x))


def _subject(value: str | None) -> str:
    value = unicodedata.normalize("NFKC", " ".join((value or "").split())).strip(C.SUBJECT_STRIP)
    return re.sub(r"^(?:the|a|an)\s+", "", value, flags=re.I).casefold()


def normalize_subject(x: str | Column) -> Column:
    """Compatibility composition, punctuation off the ends, no leading article, case folded."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_subject, na_action=None)

    return F.pandas_udf(run, "string")(F.coalesce(col(x), F.lit("")))


def stable_hash(x: str | Column, length: int = 16) -> Column:
    """The first hex digits of SHA-1."""
    return F.substring(F.sha1(col(x)), 1, length)


def unit_interval(x: str | Column) -> Column:
    """The first 64 bits of SHA-1 as a number from 0 to 1, for sampling by key."""
    return F.conv(stable_hash(x), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[([^\]]*)\]|([^/?#:\[]*))"


def source_domain(url: str | Column) -> Column:
    """Host in lower case without dots at the ends and a leading ``www.``; empty if there is none."""
    u = F.coalesce(col(url), F.lit(""))
    host = F.lower(F.concat(F.regexp_extract(u, _HOST, 1), F.regexp_extract(u, _HOST, 2)))
    return F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"^www\.", "")


def _canonical(value: str | None) -> str:
    value = (value or "").strip()
    try:
        parts = urlsplit(value)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return value.casefold()
    if not host:
        return value.casefold()
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    where = host if port in (None, default) else f"{host}:{port}"
    query = f"?{parts.query}" if parts.query else ""
    return f"//{where}{parts.path.rstrip('/') or '/'}{query}"


def canonical_url(x: str | Column) -> Column:
    """URL without scheme, fragment, default port and trailing slash."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_canonical, na_action=None)

    return F.pandas_udf(run, "string")(F.coalesce(col(x), F.lit("")))


def extract_slots(x: str | Column) -> Column:
    """Names of the slots whose words occur, in the fixed order.

    A search by pattern costs much more than one for plain characters, so a slot's pattern is tried only where one of its words
    lies in the text; texts with characters beyond ASCII, where cases fold in other ways, are always tried.
    """

    def hits(s: Column) -> Column:
        found = []
        for name, words in C.SLOT_WORDS.items():
            plain = [w.replace("\\", "") for w in words.split("|")]
            least = [w for w in plain if not any(o != w and o in w for o in plain)]  # a word with another inside it asks nothing more
            may = s["plain"].isNull()
            for w in least:
                may = may | F.contains(s["plain"], F.lit(w))
            found.append(F.when(may & s["text"].rlike(rf"(?iU)\b(?:{words})\b"), F.lit(name)))
        return F.array_compact(F.array(*found))

    text = F.coalesce(col(x), F.lit(""))
    return let(F.struct(text.alias("text"), F.when(F.octet_length(text) == F.length(text), F.lower(text)).alias("plain")), hits)


def _firsts(x: str | Column, pattern: str, clean, limit: int) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(pattern), F.lit(0))
    return F.slice(F.array_distinct(F.filter(F.transform(found, clean), lambda v: v != "")), 1, limit)


def extract_dates(x: str | Column, limit: int = 12) -> Column:
    """Dates as written, first occurrences."""
    return _firsts(x, f"(?iU){C.DATE_PATTERN}", lambda v: F.lower(normalize_space(v)), limit)


def extract_numbers(x: str | Column, limit: int = 16) -> Column:
    """Numbers with sign, currency and unit as written, without thousands commas."""
    return _firsts(x, f"(?iU){C.NUMBER_PATTERN}", lambda v: F.replace(F.lower(normalize_space(v)), F.lit(","), F.lit("")), limit)


def content_tokens(x: str | Column, limit: int = 64) -> Column:
    """Words of more than two characters that are no stop words, the most frequent first, then by name."""
    words = F.transform(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(C.TOKEN_PATTERN), F.lit(0)), F.lower)
    words = F.array_sort(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(C.STOPWORDS)))
    # equal words are neighbours now, so a count is the distance of first and last place


    def ranked(ws: Column) -> Column:
        # equal words are neighbours in the sorted array; a word's count is the distance to the next word's first place
        heads = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))

        def counted(hs: Column) -> Column:
            return F.transform(hs, lambda h, k: F.struct((h - F.coalesce(F.get(hs, k + 1), F.size(ws))).alias("n"), F.get(ws, h).alias("w")))

        return F.slice(F.transform(F.array_sort(let(heads, counted)), lambda s: s["w"]), 1, limit)

    return let(words, lambda ws: F.when(F.size(ws) > 0, ranked(ws)).otherwise(F.array().cast("array<string>")))


def jaccard(a: str | Column, b: str | Column) -> Column:
    a, b = F.coalesce(col(a), F.array().cast("array<string>")), F.coalesce(col(b), F.array().cast("array<string>"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def pair_id(a: str | Column, b: str | Column) -> Column:
    """The id of an unordered pair."""
    return F.concat(F.lit("pair-"), F.substring(F.sha1(F.concat(F.least(col(a), col(b)), F.lit("\0"), F.greatest(col(a), col(b)))), 1, 20))


def is_canonical_uuid(x: str | Column) -> Column:
    return F.coalesce(col(x).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def select_primary_tag(tags: str | Column) -> Column:
    """The tag with a subfield and the highest confidence; ties by folded names, then the first."""
    good = F.filter(col(tags), lambda t: F.coalesce(t["subfield"], F.lit("")) != "")
    name = lambda t, k: F.lower(F.coalesce(t[k], F.lit("")))
    ranked = F.transform(good, lambda t, i: F.struct((-F.coalesce(t["confidence"], F.lit(0.0))).alias("c"), name(t, "discipline").alias("d"), name(t, "field").alias("f"), name(t, "subfield").alias("s"), i.alias("i"), t.alias("tag")))
    return F.try_element_at(F.array_sort(ranked, lambda a, b: _by(a, b, "cdfsi")), F.lit(1))["tag"]


def _by(a: Column, b: Column, keys: str) -> Column:
    out = F.lit(0)
    for k in reversed(keys):
        out = F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(out)
    return out


def knowledge_point_key(tag: str | Column) -> Column:
    """The three folded levels, joined by tabs; missing ones are empty."""
    t = col(tag)
    return F.concat_ws("\t", *[F.lower(normalize_space(t[k])) for k in ("discipline", "field", "subfield")])


def pair_scores(left: Column, right: Column) -> Column:
    """Scores of two documents' features (tokens, dates, numbers, source_domain, confidence)."""
    empty = F.array().cast("array<string>")
    get = lambda s, k: F.array_distinct(F.coalesce(s[k], empty))
    ld, rd, ln, rn = get(left, "dates"), get(right, "dates"), get(left, "numbers"), get(right, "numbers")
    overlap = jaccard(left["tokens"], right["tokens"])
    date_miss = (F.size(ld) > 0) & (F.size(rd) > 0) & ~same_set(ld, rd)
    number_miss = (F.size(ln) > 0) & (F.size(rn) > 0) & ~same_set(ln, rn)
    domain = (F.coalesce(left["source_domain"], F.lit("")) != "") & F.coalesce(left["source_domain"] == right["source_domain"], F.lit(False))
    trust = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(left["confidence"], F.lit(0.0))) * F.greatest(F.lit(0.0), F.coalesce(right["confidence"], F.lit(0.0))))
    base = overlap * 6.0 + trust + F.when(domain, -0.75).otherwise(0.5)
    same = ((F.size(ld) > 0) | (F.size(ln) > 0)) & same_set(ld, rd) & same_set(ln, rn)
    return F.struct(
        F.round(overlap, 6).alias("token_jaccard"), date_miss.alias("date_mismatch"), number_miss.alias("number_mismatch"), domain.alias("same_source_domain"),
        F.round(base + F.when(same, 1.0).otherwise(0.0), 6).alias("support_score"),
        F.round(base + F.when(date_miss, 2.0).otherwise(0.0) + F.when(number_miss, 1.5).otherwise(0.0), 6).alias("conflict_score"),
    )
