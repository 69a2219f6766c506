import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from trailmine.session import local_session

    return local_session(4, 2)


@pytest.fixture(scope="session")
def data():
    found = "/root/testdata/sf0.001"
    if not os.path.isdir(found):
        pytest.skip("no test tables here")
    return found
