import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    """Invented words, common and rare."""
    draw = random.Random(5)
    syllables = ["ba", "ko", "ri", "tu", "men", "sal", "der", "vo", "ling", "est", "om", "ary"]
    return ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(800)]


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, nulls elsewhere, ties, repeated rows and one very long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n\x0b\x0c\r ", None, "a", 7), (None, "no id here at all", "en", "b", 17), (4, "one", "en", "a", 3),
        (5, "two words", "en", "b", 9), (6, long, "en", "a", len(long)), (7, "same text in two rows of it", "en", "b", 27), (7, "same text in two rows of it", "en", "b", 27),
        (8, "same text in two rows of it", None, None, 27), (9, "nbsp joins 　 and \U0001f600 stay", "fr", "c", None), (10, "\n\n\n", "fr", "c", 3),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    clash = {c: F.lit(f"x{c}") for c in ("doc", "key", "size", "n", "spans", "of", "score", "taken", "first", "label", "kind", "target", "links", "a", "b", "digest", "file")}
    return spark.createDataFrame(odd_rows, DOCS).withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
