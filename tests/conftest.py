import pytest
from fadeline.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
