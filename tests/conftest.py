import pytest

from leafmill.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", **{"spark__sql__shuffle__partitions": "4", "spark__default__parallelism": "4"})
    yield s
    s.stop()
