import pytest

AWKWARD = [
    (1, "plain words here and there and more of them", "en"), (2, "plain words here and there and more of them", "en"), (2, "plain words here and there and more of them", "en"), (3, None, None), (4, "", "xx"), (5, " \t\n ", None),
    (None, "text of a row without id but with words", "en"), (6, "é" * 40 + " ünïcode 中文 \U0001f600 words", "de"), (7, "w" * 50_000, "en"), (8, "long " * 30_000, "en"), (9, "one", "en"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    schema = "doc_id long, text string, lang string, n long, kept boolean, word string, h long, row string, start long"
    return spark.createDataFrame([(i, t, g, 1, True, "w", 3, None, None) for i, t, g in AWKWARD], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
