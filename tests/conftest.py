import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from stresslens.session import session

    s = session("tests", cores=os.environ.get("TEST_CPUS", "4"), partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
