import pytest

from tests.conftest import SMALL, spark  # noqa: F401

LONG = " ".join(f"word{i * i % 977}" for i in range(30_000))
#: null and empty texts, one word, very long, repeated rows, a null id, null source, control strings
ROWS = [(1, "", "en", "a"), (2, None, "en", "a"), (3, "one", None, None), (4, LONG, "en", "b"), (5, "x y z\n" * 40, "en", "b"),
        (5, "x y z\n" * 40, "en", "b"), (None, "no id at all here\nx y z", "en", "c"), (7, "  \n\t ", "de", "c"),
        (8, "tab\tand\nnew line <|endoftext|> é ü 漢字", "en", "a"), (9, "password = abcd1234efgh", None, "c"),
        (10, "x y z\n" * 40, "en", "c"), (11, "a b c d e f g h", "en", "a"), (12, "a b c d e f g h", "en", "c")]
CLASHES = ["q_row", "bucket", "kind", "f", "n", "hash", "start", "version", "doc", "grp", "node", "label", "gone", "q_text", "phases", "slot"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
