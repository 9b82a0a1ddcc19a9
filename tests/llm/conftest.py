import pytest


@pytest.fixture
def docs_df(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return make


@pytest.fixture(scope="session")
def table_df(spark):
    from ..conftest import DATA

    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
