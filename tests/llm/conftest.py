import pytest

LONG = "lorem ipsum dolor " * 30_000
FIRST, SECOND = (" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta"))
#: Nulls, empty and very long texts, ties and repeated rows, with columns whose names operators use themselves.
ROWS = [
    (1, None, "en", 0), (2, "", "en", 1), (3, "One line only, but it is long enough to be a key.", "en", 2), (4, LONG, None, 3), (5, LONG, "fr", 4), (6, "x", "de", 5), (7, "née\n\n  Ünï \U0001f600 \t", "fr", 6),
    (7, "née\n\n  Ünï \U0001f600 \t", "fr", 6), (None, "no id at all", "en", 7), (None, None, None, None), (8, "a" * 50_000 + "1" * 50_000, "en", 8), (9, "0123 " * 5_000, "en", 9), (11, FIRST, "en", 11), (11, SECOND, "en", 12), (12, FIRST + " more", "en", 13), (13, SECOND + " more", "en", 14), (14, SECOND, "en", 15),
    (10, "\x00\x1c\x85 odd 　 blanks", "en", 10),
]
SCHEMA = "doc_id long, text string, lang string, component_id long"


@pytest.fixture(scope="session")
def odd(spark):
    from argusframe.checkpoints import materialize

    return materialize(spark.createDataFrame(ROWS, SCHEMA), "odd")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
