import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest  # noqa: E402

from evigraph.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "4g", **{"spark.ui.showConsoleProgress": "false"})


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
