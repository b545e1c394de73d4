import sys

import pytest
from helpers import ROOT

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from fleetlens.session import get_session
    s = get_session("local[4]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
