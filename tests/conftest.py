import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from earnlens.session import checkpoint_dir, get_session
    s = get_session("local[*]", shuffle_partitions=8)
    checkpoint_dir(s, tempfile.mkdtemp(prefix="earnlens-ckpt-"))
    yield s
    s.stop()
