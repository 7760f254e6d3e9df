import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
# Python workers import the library and the tests' helpers from here, wherever pytest was started.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from citeloom.session import build_session

    session = build_session("tests", "local[4]", driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    import compare

    return compare.connect(FOLDER)
