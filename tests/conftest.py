import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from helpers import prose, rows  # noqa: E402, F401


@pytest.fixture(scope="session")
def spark():
    from shelfspark.session import build_session

    ckpt = tempfile.mkdtemp(prefix="shelfspark-test-ckpt-")
    s = build_session("local[4]", app="shelfspark-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()
