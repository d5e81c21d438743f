import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, mark string, score string, key string"


def frame(spark, rows, columns=COLUMNS):
    """Documents with nulls in columns not given, beside extra columns whose names operators use themselves."""
    width = len(columns.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], columns)


LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
ODD = [
    (1, "One two three four five six.\nalpha\nbeta\ngamma\ndelta"), (2, None, None, None), (3, ""), (3, ""), (None, "lone words here", "en", "b"),
    (None, None), (4, "alpha\nbeta\ngamma\ndelta\nnew", "en", "a"), (5, LONG, "en", "a"), (6, " \t\n\n\n \x0b", "de", "b"), (6, "é Ünï code ß 日本 text", "de", "b"),
    (7, "same text for two ids, long enough to be a shingle", "en", "c"), (8, "same text for two ids, long enough to be a shingle", "en", None),
    (8, "same text for two ids, long enough to be a shingle", "en", None), (9, "x" * 50_000, "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
