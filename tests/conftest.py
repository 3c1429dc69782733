import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def spark():
    from kbspark.session import local

    s = local("tests", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
