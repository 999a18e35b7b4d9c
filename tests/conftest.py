import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture
def db(spark, tmp_path):
    from colsql.session import Session

    return Session(spark, str(tmp_path / "db"))


@pytest.fixture(scope="session")
def tpch(spark):
    from colsql.session import Session

    return Session(spark).load(SF, "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")
