import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import session

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = session(
        "local[4]",
        4,
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=f"{scratch}/shared",
        spark__sql__warehouse__dir=f"{scratch}/warehouse",
        spark__local__dir=f"{scratch}/local",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
