import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caselens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        master="local[8]", shuffle_partitions=8, app="caselens-tests",
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
