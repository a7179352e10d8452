import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from speechtable.session import local_session, ship  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_LOCAL_DIRS", tempfile.mkdtemp(prefix="spark-"))
    return ship(local_session(cores="8", memory="8g", partitions=4))


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
