import pytest

from tallgrass.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, driver_memory="4g", partitions=4)
