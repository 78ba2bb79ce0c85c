import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, other scripts, clashing names."""
    words = " ".join(f"word{i % 997} and" for i in range(60_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "Same text here for all of us today.", "en", "a"),
        (5, "Same  text here for all of us today.", "en", "a"), (6, "Same  text here for all of us today.", None, "b"), (7, words, "en", "b"), (8, "x" * 300_000, "en", "b"),
        (9, "日本語のテキスト <|endoftext|> 🙂 ok", "ja", "c"), (10, "12 34 !?", "en", "c"), (11, "a b", "de", "c"), (11, "a b", "de", "c"),
        (None, "no id here", "en", "c"), (12, words + " tail", "en", "b"), (13, "mail me: jo.81@mail7.example.com or +1 (017) 555-7713", "en", "é"),
    ]
    clash = "id long, size long, label long, rep long, kept boolean, key string, row long, bucket int, raw string, n long, class int, shard int"
    extra = (1, 2, 3, 4, True, "k", 5, 6, "r", 7, 8, 9)
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], f"{SCHEMA}, {clash}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
