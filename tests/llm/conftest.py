import pytest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(pairs):
        return spark.createDataFrame(
            [(k, t, "x", None, 1, "y", 2) for k, t in pairs],
            "doc_id long, text string, source string, lang string, fp long, sequence_id string, n long",
        ).repartition(3)

    return make
