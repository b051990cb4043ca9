import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: Made when tests are collected, since column expressions at the top of a module need a session.
SESSION = (
    SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gridloom-shared-")).config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="gridloom-warehouse-")).getOrCreate()
)
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    return SESSION
