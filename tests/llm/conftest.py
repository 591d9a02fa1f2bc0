import pytest


@pytest.fixture
def documents(spark):
    def make(rows, more=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + more)

    return make
