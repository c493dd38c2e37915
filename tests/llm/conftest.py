import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


ODD = [
    (0, None, None, None, None),
    (1, "", "en", "s", 0),
    (2, "  \n\t ", "en", "s", 5),
    (3, "word", "en", None, 4),
    (4, "12 %% 34 !!", None, "s", 11),
    (5, "ééé ñandú straße 日本語 \x1c   \U0001d4d0 ok", "es", "t", 30),
    (6, "same text here and there", "en", "s", 24),
    (7, "same text here and there", "en", "s", 24),
    (7, "same text here and there", "en", "s", 24),
    (8, "long " * 60_000 + "tail", "en", "t", 300_004),
    (None, "no id at all but some words", "en", "s", 27),
]


@pytest.fixture(scope="session")
def odd(spark, docs_schema):
    return spark.createDataFrame(ODD, docs_schema)


@pytest.fixture(scope="session")
def clash(odd):
    """Extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    extra = "fp keys node component_id row place anchor run words lines grams bits n_words slot block mix_slot mix_position mix_block score s h id n phase bucket".split()
    return odd.select("*", *[F.lit("x").alias(c) for c in extra])
