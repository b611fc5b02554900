import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("PITCHLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pitchlens.session import build_session
    s = build_session("local[4]", 4, app_name="pitchlens-tests", driver_memory="6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
