"""Word lists, patterns and tables that results depend on."""

from __future__ import annotations

# ---- fixed values: text signals

DATE_PATTERN = (
    r"\b(?:"
    r"(?:18|19|20)\d{2}(?:[-/]\d{1,2}(?:[-/]\d{1,2})?)?"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+(?:18|19|20)\d{2}"
    r"|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+(?:18|19|20)\d{2}"
    r")\b"
)
NUMBER_PATTERN = r"(?<![\w.])[-+]?[$£€¥]?\d[\d,]*(?:\.\d+)?%?(?:\s*(?:million|billion|thousand|km|kg|miles|years?|days?|months?))?"
TOKEN_PATTERN = r"[A-Za-z0-9][A-Za-z0-9_'-]{1,}"

SLOT_WORDS = {
    "age": "age|aged|years old|year-old",
    "birth": "born|birth",
    "capacity": "capacity|seats|attendance",
    "cause": "cause|caused by|due to|resulted from",
    "date": "date|dated|occurred|happened|took place",
    "death": "died|dead|death|killed|assassinated",
    "duration": "duration|lasted|lasting|length of time",
    "founded": "founded|established|created|launched",
    "height": "height|tall",
    "location": "located|location|site|venue|headquartered",
    "membership": "members|membership|employees|staff",
    "price": "price|cost|costs|costing|priced|rent|rents|rental|worth|value",
    "rank": r"rank|ranked|ranking|no\.",
    "record": "record|wins|losses|victory|defeat",
    "release": "released|release|opens|opened|premiere|debut",
    "score": "score|scored|points|goals|yards",
    "selection": "selected|drafted|draft|picked|appointed|elected",
    "sentence": "sentenced|convicted|prison|jail",
    "size": "size|length|width|weight|weighs|area",
    "votes": "votes|voted|ballot|election|majority|tally",
}
STOPWORDS = [
    "about", "after", "again", "also", "among", "because", "before", "being", "between", "could", "from", "have", "into", "more",
    "most", "other", "over", "said", "same", "that", "their", "there", "these", "they", "this", "through", "under", "were",
    "which", "with", "would",
]
GENERIC_SUBJECTS = ["associated press", "breaking news", "read more", "reuters", "the associated press", "text size", "view full size"]
LABEL_PRIORITY = {"person": 11, "organization": 10, "event": 9, "product": 8, "work_of_art": 8, "law": 7, "facility": 6, "location": 5, "misc": 4, "norp": 3, "language": 1}
SUBJECT_STRIP = " \t\r\n,;:.()[]{}<>\"'`“”‘’"

# ---- fixed values: entities

ENTITY_LABELS = {
    "PER": "person", "PERSON": "person", "ORG": "organization", "LOC": "location", "GPE": "location", "FAC": "facility", "MISC": "misc",
    "NORP": "norp", "PRODUCT": "product", "EVENT": "event", "WORK_OF_ART": "work_of_art", "LAW": "law", "LANGUAGE": "language",
}
NAVIGATION_WORDS = [
    "about", "advertisement", "archive", "back", "blog", "browse", "click", "comment", "comments", "contact", "copyright",
    "download", "email", "facebook", "follow", "forums", "gallery", "home", "image", "images", "instagram", "login", "menu",
    "more", "next", "photo", "photos", "previous", "print", "privacy", "read", "rss", "search", "share", "subscribe", "terms",
    "twitter", "video", "videos", "view",
]
ENTITY_ALIASES = {
    "u.s": "united states", "u.s.": "united states", "us": "united states", "u.s.a": "united states", "u.s.a.": "united states", "usa": "united states",
    "u.k": "united kingdom", "u.k.": "united kingdom", "uk": "united kingdom",
}
TWO_LETTER_NAMES = ["ai", "bc", "dc", "eu", "uk", "un", "us"]
ENTITY_STRIP_MORE = "“”‘’·•…—–"

# ---- fixed values: labels

RESULT_LABELS = {"complete": "complete", "full": "complete", "full_credit": "complete", "partial": "partial", "partial_credit": "partial", "failed": "failed", "failure": "failed", "no_credit": "failed"}
JUDGE_LABELS = {"complete": "complete", "full_credit": "complete", "partial": "partial", "partial_credit": "partial", "failed": "failed", "no_credit": "failed"}
FORMULATIONS = ["named_entity", "clue_based"]
RELATIONS = ["support", "conflict", "none"]
