"""Small tables with the odd rows every operator has to bear."""

import pytest

ODD = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, fp string, score string, row string, size string, label string"
)


def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows; clashing column names."""
    rest = ("x", "y", "z", "w", "v", "u", "t")
    long_text = " ".join(f"wörd{i % 977}" for i in range(30_000))
    return [
        (1, "the cat sat on the mat", "en", "a", 22, None, *rest[:6]),
        (1, "the cat sat on the mat", "en", "a", 22, None, *rest[:6]),
        (2, None, None, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0, *rest[:6]),
        (4, " \n\t ", "en", None, 4, 1, *rest[:6]),
        (None, "no id here", "en", "b", 10, 1, *rest[:6]),
        (None, None, None, None, None, None, None, None, None, None, None, None),
        (5, long_text, "de", "b", len(long_text), 30_000, *rest[:6]),
        (6, "the cat sat on the mat", "en", "ä", 22, 6, *rest[:6]),
        (7, "password = abcdefgh12", "en", "b", 21, 3, *rest[:6]),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").cache()
