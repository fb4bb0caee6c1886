import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from newsloom.session import local_session

    os.environ.setdefault("NEWSLOOM_DRIVER_MEMORY", "4g")
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
