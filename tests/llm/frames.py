import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents as a frame, with columns whose names could clash."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return df.selectExpr("*", "1 as row", "'x' as kept", "0 as count", "'y' as place") if extra else df
    return make
