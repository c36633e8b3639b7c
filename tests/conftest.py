import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")
os.environ.setdefault("PYTHONPATH", str(Path(__file__).parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from evidentia.session import session

    held = session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="evidentia-tests-"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="evidentia-warehouse-"),
        },
    )
    held.sparkContext.setLogLevel("ERROR")
    yield held
    held.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
