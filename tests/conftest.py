import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("MOLTAB_MASTER", "local[4]")
    from moltab.session import get_spark
    s = get_spark(shuffle_partitions=8)
    yield s
