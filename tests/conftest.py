import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import build_session
    ckpt = tempfile.mkdtemp(prefix="spendlens-test-ckpt-")
    s = build_session("local[4]", 4, extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
