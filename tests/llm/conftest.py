import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "mi", "the", "lu", "so", "ran", "ti") for b in ("", "n", "rel", "st", "vo", "ka")]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short, very long, equal, near-equal and shared texts;
    repeated ids, null ids."""
    rng = random.Random(3)
    base, shared, long = text(rng, 300), text(rng, 60), text(rng, 30_000)
    changed = base.split()
    changed[150] = "changed"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Two words"), (6, base), (7, base), (8, " ".join(changed)),
            (9, text(rng, 80) + " " + shared + "\n" + text(rng, 50)), (10, shared.replace(" ", "\n") + " " + text(rng, 90)),
            (11, long), (12, "x" * 50_000), (13, "la la la " * 100), (14, text(rng, 34)), (15, text(rng, 35)),
            (6, base), (6, text(rng, 40)), (None, base), (None, text(rng, 45)), (16, "Ünïcode “quotes” <|endoftext|> 漢字 ½"),
            (17, text(rng, 5000))]
    return rows + [(100 + k, text(rng, rng.randint(1, 400))) for k in range(60)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, row long, hits string"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with further columns, some of which operators use inside."""
    rows = [(i, t, None if k % 7 == 0 else ("en", "de")[k % 2], None, len(t or ""), "w", k, None)
            for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(i, k % 4 != 0, k % 3 == 0) for k, (i, _) in enumerate(odd_rows)] + [(None, True, False), (500, None, None)]
    rows = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in rows]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
