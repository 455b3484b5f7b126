import random

import pytest

#: Extra columns bear names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, digest string, label int, key string, row string, bucket string"


def as_rows(items):
    return [(i, t, lang, source, None if t is None else len(t), 1, "n", "d", 2, "k", "r", "b") for i, t, lang, source in items]


def prose(rng, n, words=None):
    words = words or ["the", "river", "stone", "walks", "under", "Morning", "light", "and", "carries", "old", "songs", "of", "quiet", "towns", "beyond"]
    return " ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_items():
    """Nulls in every column, empty and blank texts, a very long one, ties, copies, near copies and repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    items = [
        (None, "A lonely text without any id", "en", "s1"),
        (1, None, "en", "s1"),
        (2, "", None, "s2"),
        (3, " \t\n\x0b ", "fr", None),
        (4, base, "en", "s1"),
        (5, base.upper(), "en", "s1"),
        (6, base + " tail", "en", ""),
        (7, base.replace("river", "brook", 1), "en", "s2"),
        (8, "two words", "en", "s2"),
        (9, "two  words", "en", "s2"),
        (10, "été à l'école, ÉTÉ — 数字 ١٢٣ 😀", "fr", "s3"),
        (11, prose(rng, 30_000), "en", "s3"),
        (12, "Und " * 900, "de", "s3"),
        (13, "one\ntwo\none\n\n one\nthree", "en", "s3"),
        (14, "######", None, None),
        (15, prose(rng, 60), "en", "s1"),
        (15, prose(rng, 60), "en", "s1"),
        (16, base, "en", "s1"),
        (16, base, "en", "s1"),
    ]
    items += [(100 + i, prose(rng, rng.randrange(1, 200)), "en", f"s{i % 3}") for i in range(30)]
    return items


@pytest.fixture(scope="session")
def odd_docs(spark, odd_items):
    return spark.createDataFrame(as_rows(odd_items), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
