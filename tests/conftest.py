import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from veritab.session import get_spark
    s = get_spark("local[4]", app_name="veritab-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="veritab-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def halves(spark):
    """Two small tables of own numbers, the second a little further on."""
    ref = [(0.5, 10.0, 1), (1.5, 7.0, 0), (2.0, 9.0, 0), (4.0, 3.0, 1), (7.0, 1.0, 1), (9.0, 2.0, 0)]
    cur = [(0.6, 11.0, 1), (1.4, 7.5, 1), (2.6, 9.0, 0), (4.4, 2.0, 1), (7.5, 1.5, 1)]
    schema = "width double, height double, target int"
    return spark.createDataFrame(ref, schema), spark.createDataFrame(cur, schema)
