import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and near copies."""
    long = " ".join(f"word{i % 997} und{i % 31}." for i in range(30_000))
    base = " ".join(f"term{i}" for i in range(400))
    rows = [
        (1, "The quick brown fox, the lazy dog.\nThe quick brown fox.", "en", "a", 50),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (None, "no id here at all", "en", None, 17),
        (None, None, None, None, None),
        (5, long, "de", "b", len(long)),
        (6, base, "en", "b", 1),
        (7, base + " extra", "en", "b", 1),
        (8, base, "en", "c", 1),
        (8, base, "en", "c", 1),
        (9, " leading  and\ttrailing \n", "fr", "c", 1),
        (10, "héé ñandú 日本語 <|endoftext|> </s> ▁x 😀", "es", "c", 1),
        (11, "\x00\x01 a" * 3, "xx", "d", 1),
    ]
    return rows + [(100 + i, "copy of one text " * 30, "en", "hot", 1) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


