import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from lodestone.plans.session import local_session

    session = local_session(cpus=4, partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
