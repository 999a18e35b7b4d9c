"""Where Python workers find this package, and how much they get at once."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Workers import the package from the folder that the driver has it in. Where executors have no such folder, install the
    package there or pass it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def bounded(spark: SparkSession, setting: str, most: int) -> None:
    """Arrow batches of at most this many (maxRecordsPerBatch) or about this many bytes (maxBytesPerBatch; a row alone may have more),
    as the session's settings say when a query is planned. A smaller number of the caller stays."""
    key = f"spark.sql.execution.arrow.{setting}"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))
