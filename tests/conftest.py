import pytest

from cairnlight.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores=4, partitions=4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
