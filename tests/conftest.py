import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomtext.session import local_session

    s = local_session("4", memory="4g", partitions=4)
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield s
    s.stop()
