import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import wayframe.checks.all  # noqa: E402,F401
from tests.compare import ROOT, database, session  # noqa: E402
from wayframe.runtime import tune  # noqa: E402

FOLDER = f"{ROOT}/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return tune(session())


@pytest.fixture(scope="session")
def con():
    return database(FOLDER)
