import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from reviewlake.session import session

    s = session("tests", master="local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """Turn {path: (language, content)} into a files DataFrame."""
    def make(files, project="p"):
        rows = [(project, path, language, content) for path, (language, content) in files.items()]
        return spark.createDataFrame(rows, "project_id string, path string, language string, content string")
    return make


TESTDATA = "/root/testdata/sf0.001"
