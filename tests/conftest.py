import os
import sys
import time
from pathlib import Path

import pytest

os.environ["TZ"] = "UTC"  # plain datetimes in the tests are UTC
time.tzset()
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tinderframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 4)
