import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 9]) for k in range(0, n, 9))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [
        (1, prose(1, 80), "en", "a", 1), (1, prose(1, 80), "en", "a", 1), (2, None, "en", None, None), (3, "", None, "a", 0), (4, " \n\t ", "fr", "b", 3), (5, "one", "fr", "b", 3), (6, "one two", "de", "a", 7),
        (None, prose(2, 70), "en", "a", 5), (7, prose(3, 40_000), "en", "a", 9), (8, "ÀÉ ñandú ßtraße Ωmega " * 30, "es", "b", 2), (9, "idiot " * 60, "en", "a", 2), (10, prose(1, 80), "de", "b", 1), (1, "same id, another text " * 20, "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"row": F.lit("x"), "score": F.lit("y"), "host": F.lit(1), "kept": F.lit(None).cast("string"), "token": F.lit(2), "_rank": F.lit(3)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, 1 if k % 3 else 0, 1 if k == 9 else 0) for k in range(1, 11)] + [(1, 0, 0), (1, 1, None), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
