import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 3000

ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 1),
    (2, "One two  three\tfour five six seven eight nine ten", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "de", "b", 1),
    (6, LONG, "en", "a", 9),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund und bellt laut", "de", "b", 5),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund und bellt laut", "de", "b", 5),
    (None, "a row without an id that is otherwise quite an ordinary text", "en", "c", 5),
    (None, "a row without an id that is otherwise quite an ordinary text", "en", "c", 5),
    (9, "世界 ça va? naïve \U0001f600 token", "fr", "c", 5),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, DOCS)
    for name in ("id", "fp", "grp", "component", "length", "bucket", "n", "b", "v", "score", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    # columns of any type pass through
    return df.withColumn("extra", F.expr("named_struct('m', map('k', timestamp'2024-01-01 00:00:00'), 'd', CAST(1.5 AS DECIMAL(9,2)))"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
