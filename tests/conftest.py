import os

import pytest

from sqlcorpus.session import Workspace, get_spark

os.environ.setdefault("PYTHONHASHSEED", "0")

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def workspace(spark):
    held = Workspace(spark)
    yield held
    held.close()
