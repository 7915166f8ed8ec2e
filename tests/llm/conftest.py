import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.StringType()),
])
LONG = " ".join(f"word{i % 977} and" for i in range(12_000))
TEXTS = [
    None, "", "   ", "The cat sat on the mat today.\nthe cat sat on the mat today.\nshort", "The cat sat on the mat today.\nshort", LONG, LONG,
    "<|endoftext|> it's 'RE naïve ＡＢＣ 日本語 123, x<y", "\x00\x1c  tab\tend\n\nagain", "one two three four five six seven eight nine ten",
    "one two three four five six seven eight nine eleven",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, a null id, and a column whose name clashes with a result's."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "a", None, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "an id is missing here", None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
