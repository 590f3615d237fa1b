import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Long, empty, blank, null and repeated texts, ties, and nulls in every column.
ROWS = [
    (1, "the cat sat on the mat and the dog lay by the door of the house", "en", "a", 60), (2, "the cat sat on the mat and the dog lay by the door of the house", "en", "b", 60),
    (2, "the cat sat on the mat and the dog lay by the door of the house", "en", "b", 60), (3, "", "en", "a", 0), (4, None, "en", "a", None), (5, "   \n\t ", "de", None, 6), (6, "one", None, "c", 3),
    (None, "a text without an id, which is still a text", "fr", "c", 40), (7, "word " * 30_000, "en", "a", 150_000), (8, "the cat sat on the mat and the dog lay by the gate of the house", "en", "a", 60), (None, None, None, None, None),
    (9, "der die das und in zu den von mit ist des im auf ein eine nicht als auch es an werden aus er hat dass sie nach wird bei " * 4, "de", "b", 400),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """The documents with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["n", "k", "b", "id", "t", "f", "slot", "block", "h1", "x", "keep", "reason", "window", "key", "salt", "lead", "top", "words", "chars", "secret", "a.b", "KEEP2"]
    d = spark.createDataFrame(ROWS, DOCS)
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
