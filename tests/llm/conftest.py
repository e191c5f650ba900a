import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs, or an empty one."""

    def rows(pairs, extra=""):
        from pyspark.sql import functions as F

        docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in pairs], SCHEMA)
        for name in extra.split():  # columns that an operator might use for itself
            docs = docs.withColumn(name, F.lit("x"))
        return docs

    return rows


@pytest.fixture(scope="session")
def prose():
    """Random words, the same for a seed."""
    import random

    def text(seed, n, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(9)}" for _ in range(n))

    return text


#: Rows every operator must stand: null and empty texts, null and repeated ids, equal rows, white space only, odd characters.
@pytest.fixture(scope="session")
def odd(prose):
    same = prose(1, 60)
    return [
        (1, None), (2, ""), (3, " \t\n"), (None, same), (None, None), (5, same), (5, same), (5, prose(2, 40)), (6, "one two"),
        (7, "ß é日本 😀\x00 " * 30), (-8, prose(3, 2000)), (9, "word " * 300), (10, same.upper()),
    ]
