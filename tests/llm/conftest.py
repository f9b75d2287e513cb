import pytest

DOCS = "doc_id bigint, text string"
EDGE_TEXTS = [None, "", " ", "\n\n", "a", "é", "a" * 20_000, "word " * 5_000, "x y z\n" * 300, "1 " * 3_000, "same text twice", "same text twice"]


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and columns with names that operators use."""
    rows = [(i, t, "k", 1) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id", "k", 1), (3, "\n\n", "k", 1)]
    return spark.createDataFrame(rows, DOCS + ", kept string, score int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
