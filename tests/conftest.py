import pytest

from corpusloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cpus=4, partitions=4)
