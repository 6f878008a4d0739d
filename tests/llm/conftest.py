import random

import pytest

CLASHING = "key node score size n rank label host rule text_ _id items samples place kept band source_size target u p bin".split()


def prose(rng, n):
    return " ".join(rng.choice(["the", "ther", "onre", "and", "eating", "wher", "of", "thion", "inor", "stble", "edan", "hathe"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows, repeated
    ids, and extra columns whose names clash with the operators' own."""
    rng = random.Random(0)
    long_ = prose(rng, 30_000)
    same = prose(rng, 80)
    rows = [
        (1, "plain words here and there", "en", "a", 26), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "  \n\t ", "de", "b", 5), (5, long_, "en", "a", len(long_)), (6, same, "en", "b", len(same)),
        (7, same, "en", "b", len(same)), (8, same + " changed end", "en", None, 1), (9, "12345 !!! ???", "fr", "b", 3), (10, "é" * 300, "fr", "c", 300), (11, "a" * 5000, None, "c", 5000), (11, "a" * 5000, None, "c", 5000), (12, "ab " * 900, "en", "a", 1), (12, "another text under the same id", "en", "a", 1),
        (None, "a text without an id and " + same, "en", "a", 9), (13, "<|endoftext|> x<|endoftext|>", "en", "c", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
