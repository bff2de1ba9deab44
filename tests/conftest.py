import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (HERE, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark():
    from quillgraph.functions.session import local_session

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "4")
    yield session
