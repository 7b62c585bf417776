import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for the tasks' Python


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import session

    own = session(
        os.environ.get("TEST_MASTER", "local[8]"),
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")},
    )
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
