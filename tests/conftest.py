import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from folia.session import session

    s = session("local[4]", 4, spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = os.environ.get("FOLIA_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF
