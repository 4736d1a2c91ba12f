import pytest

from corpusloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores="4", partitions=4, memory="4g")
    yield s
    s.stop()
