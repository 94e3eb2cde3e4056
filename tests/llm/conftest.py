import random

import pytest

WORDS = "the and of river stone paper light window garden music train coffee winter morning letter bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang): nulls, empty and blank texts, copies, near copies, repeated rows, one long text."""
    rng = random.Random(11)
    base = prose(rng, 260)
    out = [(i, prose(rng, rng.randrange(1, 120)), "en") for i in range(40)]
    out += [(100, base, "en"), (101, base + " ", "en"), (102, base.replace(" ", "\n  "), "en"), (103, base.replace("river", "lake", 1), "en"), (104, "x " + base, None)]
    out += [(200, None, None), (201, "", "en"), (202, " \n\t", "en"), (203, "!!! 123", "en"), (204, "Привет мир, 你好 ½²", None), (205, "a" * 1500, "en"), (206, "ab " * 700, "en")]
    out += [(300, prose(rng, 30), "en")] * 2 + [(301, base[100:700] + " tail", "en")]
    out += [(400, " ".join(prose(rng, 50) for _ in range(60)), "en"), (None, "no id here at all", "en")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names clash with what operators use inside."""
    extra = [(*r, "s", 1, "k") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, row_key int, HASH string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
