import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """documents of (doc_id, text, lang, source), with further columns of clashing names."""

    def make(rows, partitions=3):
        made = [(*r, None, None)[:4] for r in rows]
        base = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in made], SCHEMA)
        return base.repartition(partitions).selectExpr("*", "1 AS k", "'x' AS size", "2.0D AS score", "array(1) AS spans")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long and repeated texts, repeated and null ids."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "ß", "日本", "'s", "#"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    shared, copy = text(30), text(80)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, copy), (5, copy), (5, copy), (6, text(10) + "\n" + shared + " " + text(9)), (7, shared), (8, text(40) + "  " + shared)]
    rows += [(9, "a " * 300), (10, "word"), (None, copy), (11, text(5000) + shared), (5, shared + " tail"), (12, copy.replace("w1 ", "W1 ")), (13, "a " * 301)]
    return rows + [(100 + i, text(draw.randint(0, 60))) for i in range(30)]
