import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _noise string"
#: Nulls in each column, empty and very long texts, ties and repeated rows; further columns clash with operators' own names.
ODD = [
    (1, "The cat sat on the mat and looked at the moon over the quiet sea", "en", "b", 64, 0.5, "x", "n"),
    (2, "The cat sat on the mat and looked at the moon over the quiet sea", "en", "b", 64, 0.5, "x", "n"),
    (2, "The cat sat on the mat and looked at the moon over the quiet sea", "en", "b", 64, 0.5, "x", "n"),
    (3, None, "en", None, None, None, None, None),
    (4, "", None, "a", 0, 0.0, "", ""),
    (5, " \t\n\x0b\x0c\r ", "de", "a", 7, 0.1, "", ""),
    (6, "Straße zum Hafen und zurück über die Brücke", "de", None, 43, None, None, None),
    (None, "a row without an id", "en", "c", 19, None, None, None),
    (7, "12345 ... !!!", "en", "c", 13, None, None, None),
    (8, "lang " * 60_000, "de", "a", 300_000, 1.0, "z", None),
    (9, "x" * 200_000, None, "", 200_000, 1.0, "z", None),
    (10, "a", "en", "a", 1, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (4, 0, None), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
