import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from nightjar.session import build_session

    return build_session("tests", 8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
