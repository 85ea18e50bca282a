import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"
SF01 = "/root/testdata/sf0.1"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # tests run locally: no cluster checkpoint folder is configured, so set one
    ckpt = tempfile.mkdtemp(prefix="backlist-ckpt-")
    from backlist.session import get_spark
    s = get_spark("backlist-tests", cpus=4, shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": ckpt})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()
