import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from helixmart.session import get_session

    return get_session("tests")


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
