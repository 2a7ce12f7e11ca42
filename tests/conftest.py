import os

import pytest

from gravelbed.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session(8)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
