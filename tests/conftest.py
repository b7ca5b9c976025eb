import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from librarium.session import local_session

    s = local_session(4, 4, spark__sql__adaptive__coalescePartitions__enabled="true")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA
