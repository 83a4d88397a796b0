import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from varscope.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="varscope-tests")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="varscope-test-ckpt-"))
    yield s
    s.stop()


def frame(spark, data: dict, schema: str | None = None):
    """Build a small DataFrame from columns (lists of equal length)."""
    cols = list(data)
    rows = list(zip(*[data[c] for c in cols]))
    return spark.createDataFrame(rows, schema or cols)
