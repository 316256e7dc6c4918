import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def odd_documents(spark, n=60, seed=3):
    """Documents with nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    rng = random.Random(seed)
    words = ["the", "and", "of", "thing", "stone", "river", "über", "señor", "forêt", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), rng.choice([1, 5, None])) for i in range(n)]
    rows += [(None, "a text without id", "en", "a", 3), (n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t", "fr", "b", 3), (n + 3, "word " * 40_000, "en", "a", 200_000)]
    rows += rows[:5] + [(n + 4, rows[7][1], "en", "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as n_tokens", "'own' as score", "'own' as component", "'own' as confidence", "'own' as prob", "'own' as key", "'own' as block", "'own' as tokens", "'own' as bucket")


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0).cache()
