"""Queries over whole tables: rows that a cap, a filter or a fold once left out."""

import random
import re

from contrasto.functions.entities import entity_name, plausible_entity
from contrasto.plans import catalog


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _spans(text):
    """(start, end) of runs of labelled words, from the definition."""
    out, last, at = [], None, 0
    for w in text.split(" "):
        start, end = at, at + len(w)
        at = end + 1
        if not w:
            continue
        if not (re.match("[A-Z]", w) or re.search("[,.]$", w)):
            last = None
            continue
        if last is None or start > last + (1 if re.match("[A-Z]", w) else 2):
            out.append([start, end])
        out[-1][1] = last = end
    return out


def test_decode_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    words = ["Anna", "Lee", "Übung", "river", "stone,", "end.", "", "mid", "😀", "Bo", "x"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, make(50), "en"), (2, make(4000), "en"), (3, make(300), "de"), (4, make(200), None), (5, None, "en"), (6, "", "en"), (7, make(401), "fr")]
    want = []
    for d, text, _ in rows:
        for s, e in _spans(text or ""):
            surface = re.sub(r"^[\s,.]+|[\s,.]+$", "", text[s:e])
            if plausible_entity(surface, entity_name(surface)):
                want.append((d, surface, entity_name(surface), "person", s, e))
    got = catalog.QUERIES["f29_decode_mentions"](spark, _documents(spark, tmp_path, rows))
    assert got.schema["start"].dataType.simpleString() == "int"
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {w[0] for w in want} == {1, 2, 3, 4, 7}
